"""Queries over the given tables, one or more for each operator, and the DuckDB SQL that they are held against.

The tables stand in for the engine's own data: conversations for sessions, documents for notes (their kind by source), pages for a
profile corpus, events for a log (the kinds of event as kinds of log entry, user and k of props as names), and region, nation and
part brands for the ledger.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallystone.config import GENERIC, Config
from tallystone.functions import text as T
from tallystone.operators import chunk, extract, index, ingest, projections, registry, review, search
from tallystone.sources import corpus, log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TERMS = ["the", "disgusting", "idiot"]
NOW = 2_000_000_000.0
STATES = {"view": projections.DEFERRED, "click": projections.OPENED, "purchase": projections.RESOLVED, "error": projections.RESOLVED, "signup": "episode_added"}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            log = sql.startswith((f"WITH {EVENTS}", f"WITH {LIFE}"))  # "at" is a word of DuckDB's
            SQL[name or f.__name__] = re.sub(r"""(?<![\w"'])at(?![\w"'])""", '"at"', sql) if log else sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has but few row groups to read; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores and df.count() < 1_000_000 else df


_made: dict[tuple, str] = {}


def scratch(spark: SparkSession, name: str, d: str) -> tuple[Path, bool]:
    """A folder for what is derived from the tables in d, and whether it is new: once a session, beside the session's checkpoints if it has a folder for them."""
    key = (spark.sparkContext.applicationId, name, d)
    if key in _made:
        return Path(_made[key]), False
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = Path(base) / f"{name}-{uuid.uuid4().hex[:12]}" if base else Path(tempfile.mkdtemp(prefix=f"{name}-"))
    folder.mkdir(parents=True, exist_ok=True)
    _made[key] = str(folder)
    return folder, True


def indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, postings and totals of the notes' index, which is built by the first query of a session that needs it."""
    folder, new = scratch(spark, "index", d)
    if new or not (folder / "made" / "stats").exists():
        index.write(note_chunks(spark, d), f"{folder}/made", repeated(spark, d))
    return index.tables(spark, f"{folder}/made")


def repeated(spark: SparkSession, d: str) -> bool:
    """Whether several documents have one number, and so one path."""
    return not t(spark, d, "documents").groupBy("doc_id").count().where("count > 1").isEmpty()


# ---- adapters, each with its SQL

def events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.col("user_id").cast("string").alias("writer"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "value")


EVENTS = "ev AS (SELECT event_type AS type, event_id AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(user_id AS VARCHAR) AS writer, CAST(json_extract(props, '$.k') AS INT) AS k, ts, value FROM events)"


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """events as a log of proposals: user and k name one, the kind of event is what happened to it."""
    kinds = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    decision = F.when(F.col("type") == "purchase", "approved").when(F.col("type") == "error", "rejected")
    e = events(spark, d)
    pid = F.concat("writer", F.lit("_"), F.col("k").cast("string"))
    return e.select(kinds[F.col("type")].alias("type"), "pos", "at", "writer", pid.alias("proposal_id"), F.when(F.col("k") % 2 == 0, "entity").otherwise("commitment").alias("kind"), F.concat(F.lit("Name "), pid).alias("name"), F.concat(F.lit("key-"), pid).alias("key"), decision.alias("decision"), F.col("at").alias("note"), F.concat(F.lit("ep_"), F.col("k").cast("string")).alias("episode_id"))


LIFE = EVENTS + ", life AS (SELECT CASE type WHEN 'view' THEN 'proposal_deferred' WHEN 'click' THEN 'proposal_opened' WHEN 'signup' THEN 'episode_added' ELSE 'proposal_resolved' END AS type, pos, at, writer, writer || '_' || k AS proposal_id, CASE WHEN k % 2 = 0 THEN 'entity' ELSE 'commitment' END AS kind, 'Name ' || writer || '_' || k AS name, 'key-' || writer || '_' || k AS key, CASE type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' END AS decision, 'ep_' || k AS episode_id FROM ev)"
PROPOSALS = LIFE + """, raised AS (SELECT proposal_id, coalesce(min_by(at, CASE WHEN type = 'proposal_opened' THEN pos END) FILTER (type = 'proposal_opened'), max_by(at, pos) FILTER (type = 'proposal_deferred')) AS at,
 CASE WHEN count(*) FILTER (type = 'proposal_opened') > 0 THEN 'queued' ELSE 'deferred' END AS st, min(pos) AS first, any_value(kind) AS kind, any_value(name) AS name, any_value(key) AS key FROM life WHERE type IN ('proposal_opened', 'proposal_deferred') GROUP BY 1),
 dec AS (SELECT proposal_id, max_by(decision, pos) AS decision FROM life WHERE type = 'proposal_resolved' GROUP BY 1),
 props AS (SELECT r.proposal_id, r.at, r.kind, r.name, r.key, coalesce(d.decision, r.st) AS state, r.first FROM raised r LEFT JOIN dec d USING (proposal_id))"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("source").isin("src0", "src1"), "profile").when(F.col("source") == "src2", "state").otherwise("note").alias("kind"), "text", (F.lit(NOW) - F.pmod("doc_id", F.lit(90)) * 86400).cast("double").alias("mtime"))


NOTES = f"notes AS (SELECT 'doc/' || doc_id AS path, CASE WHEN source IN ('src0', 'src1') THEN 'profile' WHEN source = 'src2' THEN 'state' ELSE 'note' END AS kind, text, CAST({NOW} - (doc_id % 90) * 86400 AS DOUBLE) AS mtime FROM documents)"


def note_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).withColumn("tail", F.lit(""))
    return chunk.explode_chunks(n, chunk.markdown_chunks(F.col("text")), ["path", "kind", "mtime", "tail"]).select(*search.KEEP)


#: No document has a heading, and a last window always has over 80 characters, so windows are chunks.
CHUNKS = NOTES + """, win AS (SELECT path, kind, mtime, unnest(range(0, CAST(greatest(ceil((length(text) - 1500) / 1300.0), 0) AS BIGINT) + 1)) AS i, text FROM notes WHERE trim(text) <> ''),
 chunks AS (SELECT path, kind, mtime, i + 1 AS seq, count(*) OVER (PARTITION BY path) AS nseq, substring(text, i * 1300 + 1, 1500) AS body FROM win)"""
BIGRAMS = r"flatten(list_transform(regexp_extract_all({x}, '[0-9A-Z_a-z][-.0-9A-Z_a-z]*|[^\x00-\x7F]+'), lambda x: CASE WHEN ascii(x) < 128 THEN [lower(x)] WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) END))"
TOKENS = r"list_filter(string_split_regex(lower(array_to_string(" + BIGRAMS + r", ' ')), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')"
WORDS = CHUNKS + ", w AS MATERIALIZED (SELECT path, kind, mtime, seq, nseq, body, " + TOKENS.format(x="body") + " AS words FROM chunks)"
FREQ = WORDS + ", f AS MATERIALIZED (SELECT path, kind, mtime, seq, nseq, body, len(words) AS dl, " + ", ".join(f"len(list_filter(words, lambda x: x = '{x}')) AS f{i}" for i, x in enumerate(TERMS)) + " FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(3)) + " FROM f)"
_IDF = "CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
BM25 = FREQ + ", r AS (SELECT f.*, s.*, " + " + ".join(f"({_IDF.format(i=i)}) * (f{i} * 2.2) / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3)) + " AS bm25 FROM f, s WHERE f0 > 0 OR f1 > 0 OR f2 > 0)"
TOP = BM25 + ", top AS (SELECT * FROM r ORDER BY round(bm25, 9) DESC, path, seq LIMIT 200)"


OF_TWO = "WHERE kind IN ('profile', 'state') "


def _pipeline_sql(recency: bool = False, ratio: float = 0.35, k: int = 5, where: str = "") -> str:
    w = "CASE kind WHEN 'note' THEN 1.25 WHEN 'profile' THEN 1.20 WHEN 'state' THEN 1.15 ELSE 1.0 END"
    bonus = f" * (1 + 0.5 * exp(-(({NOW} - mtime) / 86400.0) / 30.0))" if recency else ""
    cov = "(" + " + ".join(f"CASE WHEN ln((n + 1) / (n{i} + 1)) > 0 AND contains(lower(body), '{x}') THEN ln((n + 1) / (n{i} + 1)) ELSE 0 END" for i, x in enumerate(TERMS)) + ") / (" + " + ".join(f"ln((n + 1) / (n{i} + 1))" for i in range(3)) + ")"
    return TOP.replace("FROM r ORDER", f"FROM r {where}ORDER") + f""", sc AS (SELECT *, round(bm25 * ({w}){bonus}, 3) AS score FROM top), gate AS (SELECT * FROM sc WHERE score >= (SELECT max(score) FROM sc) * {ratio}),
 one AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, round(bm25, 9) DESC, path, seq) AS rn FROM gate),
 hits AS (SELECT * FROM one WHERE rn = 1 ORDER BY score DESC, round(bm25, 9) DESC, path, seq LIMIT {k}),
 res AS (SELECT path, kind, seq, nseq, body, mtime, score, round({cov}, 3) AS coverage, row_number() OVER (ORDER BY score DESC, round(bm25, 9) DESC, path, seq) AS rank FROM hits)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """entities(id, canonical_name, aliases, confusable_with, pos): places, then brands."""
    places = t(spark, d, "region").select(F.col("r_name").alias("n")).union(t(spark, d, "nation").select("n_name")).select("n", F.lit("place").alias("ty"), F.lit(0).alias("o"))
    brands = t(spark, d, "part").select(F.col("p_brand").alias("n"), F.lit("thing").alias("ty"), F.lit(1).alias("o")).distinct()
    e = places.union(brands).withColumn("pos", F.row_number().over(Window.orderBy("o", "n")))
    alias = F.when(F.col("ty") == "thing", F.array(F.concat(F.lit("B-"), F.regexp_extract("n", r"(\d+)", 1)), F.lit("wife"))).otherwise(F.array(F.initcap(F.lower("n"))))
    return e.select(F.concat("ty", F.lit(":"), T.slugify("n")).alias("id"), F.col("n").alias("canonical_name"), alias.alias("aliases"), F.when(F.col("pos") % 3 == 0, F.array(F.lit("place:asia"), F.lit("thing:none"))).otherwise(F.array().cast("array<string>")).alias("confusable_with"), "pos")


LEDGER = """raw AS (SELECT n, ty, row_number() OVER (ORDER BY o, n) AS pos FROM (SELECT r_name AS n, 'place' AS ty, 0 AS o FROM region UNION ALL SELECT n_name, 'place', 0 FROM nation UNION ALL SELECT DISTINCT p_brand, 'thing', 1 FROM part)),
 ent AS (SELECT ty || ':' || trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') AS id, n AS canonical_name, CASE WHEN ty = 'thing' THEN ['B-' || regexp_extract(n, '(\\d+)', 1), 'wife'] ELSE [array_to_string(list_transform(string_split(lower(n), ' '), lambda x: upper(x[1]) || x[2:]), ' ')] END AS aliases, CASE WHEN pos % 3 = 0 THEN ['place:asia', 'thing:none'] ELSE [] END AS confusable_with, pos FROM raw),
 forms0 AS (SELECT id, pos, i, list_prepend(canonical_name, aliases)[i] AS name FROM ent, unnest(range(1, len(aliases) + 2)) u(i)),
 forms AS (SELECT lower(regexp_replace(name, '\\s+', '', 'g')) AS norm, min(pos * 100 + i) AS place, max_by(id, pos * 100 + i) AS id FROM forms0 GROUP BY 1)""".replace("\\\\", "\\")


# ---- the log

@query(f"WITH {EVENTS} SELECT type, at, writer, k, pos FROM ev WHERE type IN ('click', 'purchase') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def log_scan_type_since(spark, d):
    e = events(spark, d)
    since = e.agg((F.max("ts") - F.expr("INTERVAL 5 DAY")).alias("since"))
    return e.where(F.col("type").isin("click", "purchase")).join(F.broadcast(since), F.col("ts") >= F.col("since")).select("type", "at", "writer", "k", "pos")


@query(f"WITH {EVENTS} SELECT substring(at, 1, 7) AS month, type, count(*) AS events FROM ev GROUP BY ALL")
def log_month_partition_counts(spark, d):
    return events(spark, d).groupBy(T.month_key("at").alias("month"), "type").agg(F.count("*").alias("events"))


@query(f"WITH {EVENTS}, n AS (SELECT pos, CASE WHEN pos % 7 <> 0 THEN type END AS type, CASE WHEN pos % 11 = 0 THEN '' ELSE at END AS at, writer FROM ev) SELECT pos, coalesce(type, '') <> '' AND coalesce(at, '') <> '' AND coalesce(writer, '') <> '' AS valid FROM n")
def log_validate_envelope(spark, d):
    e = events(spark, d).withColumns({"type": F.when(F.col("pos") % 7 != 0, F.col("type")), "at": F.when(F.col("pos") % 11 == 0, "").otherwise(F.col("at"))})
    return e.select("pos", F.expr("coalesce(type, '') <> '' and coalesce(at, '') <> '' and coalesce(writer, '') <> ''").alias("valid"))


@query(f"WITH {LIFE} SELECT DISTINCT episode_id FROM life WHERE type = 'episode_added' AND episode_id <> ''")
def projection_distinct_ids(spark, d):
    return projections.episode_ids(lifecycle(spark, d))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, max(turn + 1) AS cursor FROM conversations GROUP BY 1")
def projection_cursors(spark, d):
    c = t(spark, d, "conversations")
    e = c.select(F.lit("episode_added").alias("type"), F.struct(F.col("conv_id").cast("string").alias("session_id"), F.array(F.col("turn"), F.col("turn") + 1).alias("turn_range")).alias("source"))
    return projections.session_cursors(e)


@query("WITH m AS (SELECT user_id, max(ts) AS mtime FROM events GROUP BY 1), c AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY 1) SELECT m.user_id, epoch(m.mtime) AS mtime FROM m LEFT JOIN c USING (user_id) WHERE m.mtime > coalesce(c.seen, TIMESTAMP '1970-01-01')")
def note_mtime_incremental(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("source_file"), F.expr("unix_micros(cast(ts AS timestamp)) / 1e6D").alias("mtime"), "event_type")
    seen = projections.note_mtimes(e.where("event_type = 'view'").withColumn("type", F.lit("commitment_scanned"))).withColumnRenamed("mtime", "seen")
    files = e.groupBy("source_file").agg(F.max("mtime").alias("mtime"))
    return files.join(seen, "source_file", "left").where("mtime > coalesce(seen, 0)").select(F.col("source_file").cast("long").alias("user_id"), "mtime")


SESSION = "parts AS (SELECT conv_id, turn, coalesce(role, '') || chr(0) || coalesce(text, '') AS p FROM conversations)"


@query(f"WITH {SESSION} SELECT conv_id, 'ep_' || conv_id || '_0-' || count(*) || '_' || substring(sha256(string_agg(p, chr(30) ORDER BY turn)), 1, 16) AS episode_id FROM parts GROUP BY conv_id")
def episode_content_hash(spark, d):
    s = chunk.turns_to_sessions(t(spark, d, "conversations"))
    return s.select("conv_id", ingest.episode_id(F.col("conv_id").cast("string"), F.lit(0), F.size("turns"), F.col("turns")).alias("episode_id"))


def _plan(spark, d):
    s = chunk.turns_to_sessions(t(spark, d, "conversations")).select(F.col("conv_id").cast("string").alias("session_id"), F.lit("x").alias("path"), F.lit(False).alias("archived"), "turns")
    cursors = s.select("session_id", F.floor(F.size("turns") / 2).cast("int").alias("cursor"))
    known = s.where("session_id like '%3'").select(ingest.episode_id(F.col("session_id"), F.floor(F.size("turns") / 2).cast("int"), F.size("turns"), F.slice("turns", F.floor(F.size("turns") / 2).cast("int") + 1, F.size("turns"))).alias("episode_id"))
    return ingest.plan(s, cursors, known)


INCREMENT = f"{SESSION}, c AS (SELECT conv_id, count(*) AS n, CAST(floor(count(*) / 2) AS INT) AS cur FROM conversations GROUP BY 1), eps AS (SELECT CAST(p.conv_id AS VARCHAR) AS session_id, min(c.cur) AS start, min(c.n) AS \"end\", 'ep_' || p.conv_id || '_' || min(c.cur) || '-' || min(c.n) || '_' || substring(sha256(string_agg(p, chr(30) ORDER BY turn)), 1, 16) AS episode_id FROM parts p JOIN c USING (conv_id) WHERE turn >= cur GROUP BY p.conv_id)"


@query(f"WITH {INCREMENT} SELECT session_id, start, \"end\", episode_id FROM eps")
def episode_incremental_slice(spark, d):
    return _plan(spark, d).select("session_id", "start", "end", "episode_id")


@query(f"WITH {INCREMENT} SELECT session_id, episode_id FROM eps WHERE session_id NOT LIKE '%3'")
def episode_anti_join_known(spark, d):
    return _plan(spark, d).where("not known").select("session_id", "episode_id")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE conv_id % 5 = 0")
def canary_missing_sources(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id"), F.struct(F.col("conv_id").cast("string").alias("session_id")).alias("source"))
    return ingest.missing_sources(c, c.where("conv_id % 5 <> 0").select("source.session_id").distinct())


@query("WITH m AS (SELECT DISTINCT strftime(DATE '2024-01-01' + INTERVAL 1 MONTH * CAST(event_id % 60 AS INT), '%Y-%m') AS month FROM events WHERE event_id % 60 % 7 <> 3), r AS (SELECT CAST(min(month) || '-01' AS DATE) AS a, CAST(max(month) || '-01' AS DATE) AS b FROM m) SELECT strftime(x, '%Y-%m') AS month FROM r, unnest(generate_series(a, b, INTERVAL 1 MONTH)) u(x) WHERE strftime(x, '%Y-%m') NOT IN (SELECT month FROM m)")
def canary_month_gaps(spark, d):
    m = t(spark, d, "events").where("event_id % 60 % 7 <> 3").select(F.date_format(F.add_months(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 60).cast("int")), "yyyy-MM").alias("month"))
    return ingest.month_gaps(m)


# ---- proposals

@query(f"WITH {PROPOSALS} SELECT proposal_id, at, kind, name, key, state, first FROM props")
def proposal_projection(spark, d):
    return projections.proposals(lifecycle(spark, d), ["at", "kind", "name", "key"]).drop("resolved_at", "resolution_note")


@query(f"WITH {PROPOSALS} SELECT proposal_id, at, first FROM props WHERE state = 'queued' AND kind = 'entity'")
def proposal_pending(spark, d):
    p = projections.proposals(lifecycle(spark, d), ["at", "kind", "name", "key"])
    return projections.pending(p, "entity").select("proposal_id", "at", "first")


@query(f"WITH {PROPOSALS} SELECT DISTINCT kind, CASE WHEN kind = 'entity' THEN lower(regexp_replace(name, '\\s+', '', 'g')) ELSE key END AS known FROM props")
def proposed_names_and_keys(spark, d):
    p = projections.proposals(lifecycle(spark, d), ["at", "kind", "name", "key"])
    return projections.proposed_names(p).select(F.lit("entity").alias("kind"), F.col("name").alias("known")).union(projections.proposed_keys(p).select(F.lit("commitment"), "key"))


@query(f"WITH {LIFE}, d AS (SELECT proposal_id, min(pos) AS pos FROM life WHERE type = 'proposal_deferred' GROUP BY 1) SELECT proposal_id, pos FROM d WHERE proposal_id NOT IN (SELECT proposal_id FROM life WHERE type IN ('proposal_opened', 'proposal_resolved')) ORDER BY pos LIMIT 10")
def proposal_drain(spark, d):
    return projections.to_drain(lifecycle(spark, d), 10).select("proposal_id", "pos")


@query(f"WITH {LIFE} SELECT proposal_id, kind, pos, row_number() OVER (PARTITION BY kind ORDER BY pos) > 10 AS deferred FROM life WHERE type = 'proposal_opened'")
def proposal_budget_defer(spark, d):
    return projections.within_budget(lifecycle(spark, d).where("type = 'proposal_opened'"), 10).select("proposal_id", "kind", "pos", "deferred")


@query(f"WITH {EVENTS} SELECT writer, k, pos, CAST(floor((row_number() OVER (ORDER BY pos) - 1) / 10) AS INT) AS batch FROM ev WHERE type = 'signup'")
def batch_assignment(spark, d):
    return projections.batches(events(spark, d).where("type = 'signup'"), 10).select("writer", "k", "pos", "batch")


def _seen(spark, d):
    p = t(spark, d, "part")
    return p.select(F.lit("entity_candidate_seen").alias("type"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_brand").alias("name"), F.lit("thing").alias("entity_type"), F.array(F.col("p_type")).alias("aliases"), F.col("p_name").alias("context"), F.concat(F.lit("ep"), F.col("p_size").cast("string")).alias("source_episode_id"))


SEEN = "sn AS (SELECT lower(replace(p_brand, ' ', '')) AS norm, count(DISTINCT p_size) AS episodes, ' ' || max_by(p_brand, p_partkey) AS name, max_by(p_name, p_partkey) AS note, min(p_partkey) AS first FROM part GROUP BY 1)"


@query(f"WITH {SEEN} SELECT norm, name, note, episodes, first FROM sn WHERE episodes >= 3 AND norm NOT IN ('brand#12')")
def candidate_promotion_threshold(spark, d):
    known = spark.createDataFrame([("brand#12",)], "norm string")
    s = projections.sightings(_seen(spark, d)).where("size(episodes) >= 3").join(known, "norm", "left_anti")
    return s.select("norm", "name", "note", F.size("episodes").cast("long").alias("episodes"), "first")


@query(f"""WITH RECURSIVE {SEEN}, c AS (SELECT norm, row_number() OVER (ORDER BY first) AS i FROM sn WHERE episodes >= 3),
 step AS (SELECT 0 AS i, [] :: VARCHAR[] AS done, '' AS norm, false AS ok UNION ALL
 SELECT c.i, CASE WHEN hit THEN done ELSE list_append(done, c.norm) END, c.norm, NOT hit FROM (SELECT s.i, s.done, len(list_filter(s.done, lambda x: (contains(x, c2.norm) OR contains(c2.norm, x)) AND x <> c2.norm)) > 0 AS hit FROM step s JOIN c c2 ON c2.i = s.i + 1) q JOIN c ON c.i = q.i + 1)
 SELECT norm, ok AS confirmed FROM step WHERE i > 0""")
def candidate_promotion_greedy(spark, d):
    """Confirmed one after the other in the order of first sighting; the candidates of a run are few, and are folded on the driver."""
    rows = projections.sightings(_seen(spark, d)).where("size(episodes) >= 3").orderBy("first").select("norm").collect()
    led, out = registry.Ledger(), []
    for r in rows:
        hit = led.collision(r.norm)
        if hit is None:
            led.add("thing", r.norm)
        out.append((r.norm, hit is None))
    return spark.createDataFrame(out, "norm string, confirmed boolean")


# ---- the ledger

@query("WITH n AS (SELECT p_name AS name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_type FROM part) SELECT name, lower(regexp_replace(name, '\\s+', '', 'g')) AS norm, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN name IN ('person', 'place') THEN name ELSE 'thing' END AS kind FROM n")
def normalize_slugify(spark, d):
    n = t(spark, d, "part").select(F.col("p_name").alias("name")).union(t(spark, d, "nation").select("n_name")).union(t(spark, d, "supplier").select("s_name")).union(t(spark, d, "part").select("p_type"))
    return n.select("name", T.normalize("name").alias("norm"), T.slugify("name").alias("slug"), T.coerce_type("name").alias("kind"))


@query(f"WITH {LEDGER} SELECT DISTINCT p_brand AS name, f.id AS entity_id FROM part LEFT JOIN forms f ON lower(replace(p_brand, ' ', '')) = f.norm UNION ALL SELECT lower(n_name), f.id FROM nation LEFT JOIN forms f ON lower(regexp_replace(n_name, '\\s+', '', 'g')) = f.norm")
def ledger_lookup(spark, d):
    names = t(spark, d, "part").select(F.col("p_brand").alias("name")).distinct().union(t(spark, d, "nation").select(F.lower("n_name")))
    return registry.lookup(names, registry.surface_forms(ledger(spark, d)))


@query(f"WITH {LEDGER}, n AS (SELECT DISTINCT name, lower(regexp_replace(name, '\\s+', '', 'g')) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'x ' || r_name FROM region)) SELECT n.name, min_by(f.id, f.place) AS entity_id, min_by(f.norm, f.place) AS \"with\" FROM n JOIN forms f ON n.n <> f.norm AND length(n.n) >= 2 AND length(f.norm) >= 2 AND (contains(n.n, f.norm) OR contains(f.norm, n.n)) GROUP BY 1")
def ledger_collision(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name").alias("name")).union(t(spark, d, "part").select("p_brand")).union(t(spark, d, "region").select(F.concat(F.lit("x "), "r_name")))
    return registry.collisions(n, registry.surface_forms(ledger(spark, d)))


@query(f"WITH {LEDGER}, one AS (SELECT id, unnest(confusable_with) AS o FROM ent), k AS (SELECT id, o FROM one WHERE o IN (SELECT id FROM ent) AND o <> id), b AS (SELECT id, o FROM k UNION SELECT o, id FROM k) SELECT id, array_to_string(list(o ORDER BY o), ',') AS confusable_with FROM b GROUP BY 1")
def confusable_symmetric(spark, d):
    return registry.symmetric(ledger(spark, d)).select("id", F.array_join("confusable_with", ",").alias("confusable_with"))


ALIASES = LEDGER + ", nm AS (SELECT pos, list_filter(list_prepend(canonical_name, aliases), lambda x: lower(x) <> 'wife') AS names FROM ent), am AS (SELECT name, array_to_string(list_transform(flatten(list(names ORDER BY pos)), lambda x: x), ',') AS all_forms FROM (SELECT pos, names, unnest(names) AS name FROM nm WHERE len(names) >= 2) GROUP BY 1)"


@query(f"WITH {ALIASES}, x AS (SELECT name, string_split(all_forms, ',') AS l FROM am) SELECT name, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS forms FROM x")
def alias_map(spark, d):
    return registry.alias_pairs(ledger(spark, d), GENERIC).select("name", F.array_join("forms", ",").alias("forms"))


@query(f"WITH {ALIASES}, x AS (SELECT name, string_split(all_forms, ',') AS l FROM am), q AS (SELECT DISTINCT p_brand AS term FROM part UNION ALL SELECT 'absent') SELECT term, coalesce(array_to_string(list_filter(l, lambda v: v <> term), ','), '') AS added FROM q LEFT JOIN x ON x.name = q.term")
def alias_expand_terms(spark, d):
    q = t(spark, d, "part").select(F.col("p_brand").alias("term")).distinct().union(spark.createDataFrame([("absent",)], "term string"))
    m = registry.alias_pairs(ledger(spark, d), GENERIC)
    return q.join(m, q.term == m.name, "left").select("term", F.coalesce(F.array_join(F.array_except("forms", F.array("term")), ","), F.lit("")).alias("added"))


# ---- text and chunks

@query(f"SELECT conv_id, turn, array_to_string({TOKENS.format(x='text')}, ' ') AS tokens FROM conversations")
def tokens_bigram(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.tokens("text"), " ").alias("tokens"))


EST = r"CAST(floor(length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g')) / 4) + length({x}) - length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g')) AS INT)"


@query(f"SELECT doc_id, {EST.format(x='text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query(f"WITH x AS (SELECT doc_id, text, {EST.format(x='text')} AS n, substring(text, 1, 164) AS h FROM documents), y AS (SELECT *, list_max(list_filter(range(0, length(h) + 1), lambda i: {EST.format(x='substring(h, 1, i)')} <= 39)) AS m FROM x) SELECT doc_id, CASE WHEN n <= 40 THEN text ELSE regexp_replace(substring(h, 1, m), '\\s+$', '') || '…' END AS cut FROM y")
def truncate_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", T.truncate_to_tokens("text", 40).alias("cut"))


@query("WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1500) / 1300.0), 0) AS BIGINT) + 1)) AS i FROM documents) SELECT doc_id, CAST(i AS INT) AS i, substring(text, i * 1300 + 1, 1500) AS piece FROM w")
def split_long_windows(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.split_long("text")).alias("i", "piece"))


@query("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
 h AS (SELECT doc_id, i, CASE WHEN i % 9 = 5 THEN '## ' ELSE '' END || line AS line FROM l), g AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^#{1,4} .+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
 seg AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY i) || CASE WHEN s < max(s) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS body, min_by(line, i) AS head FROM g GROUP BY doc_id, s),
 p AS (SELECT doc_id, s, k, CASE WHEN regexp_matches(head, '^#{1,4} .+$') THEN trim(ltrim(head, '# ')) ELSE '' END AS section, substring(body, k * 1300 + 1, 1500) AS body FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((length(body) - 1500) / 1300.0), 0) AS BIGINT) + 1)) AS k FROM seg)),
 q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) AS o, regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '') AS bare FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS o2 FROM q WHERE bare <> ''),
 st AS (SELECT *, sum(CASE WHEN length(bare) >= 80 OR o2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o2) AS grp FROM z), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, grp) AS m, row_number() OVER (PARTITION BY doc_id, grp ORDER BY o2) AS j FROM st)
 SELECT doc_id, CAST(grp AS INT) AS seq, min_by(section, o2) AS section, string_agg(CASE WHEN m = 1 THEN body WHEN j = 1 THEN regexp_replace(body, '\\s+$', '') ELSE bare END, chr(10) ORDER BY o2) AS body FROM c GROUP BY doc_id, grp""")
def markdown_chunks(spark, d):
    """Headings are put before every ninth line from the fifth, as no document has any."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 9 == 4, F.concat(F.lit("## "), x)).otherwise(x))
    doc = t(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunk.explode_chunks(doc, chunk.markdown_chunks(F.col("text")), ["doc_id"]).select("doc_id", "seq", "section", "body")


@query("""WITH RECURSIVE l AS (SELECT conv_id, turn, '[] ' || coalesce(role, '?') || ': ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE coalesce(text, '') <> ''),
 s AS (SELECT conv_id, i, length(line) AS n, 1 AS g FROM l WHERE i = 1 UNION ALL SELECT l.conv_id, l.i, CASE WHEN s.n >= 1500 THEN length(l.line) ELSE s.n + 1 + length(l.line) END, CASE WHEN s.n >= 1500 THEN s.g + 1 ELSE s.g END FROM s JOIN l ON l.conv_id = s.conv_id AND l.i = s.i + 1),
 b AS (SELECT s.conv_id, g, string_agg(line, chr(10) ORDER BY s.i) AS body FROM s JOIN l USING (conv_id, i) GROUP BY ALL),
 w AS (SELECT conv_id, g, body AS whole, unnest(range(0, CAST(greatest(ceil((length(body) - 1500) / 1300.0), 0) AS BIGINT) + 1)) AS k FROM b),
 p AS (SELECT conv_id, g, k, substring(whole, k * 1300 + 1, 1500) AS body, length(whole) >= 1500 AS closed, row_number() OVER (PARTITION BY conv_id ORDER BY g, k) AS o FROM w),
 q AS (SELECT *, regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '') AS bare FROM p),
 f AS (SELECT *, CASE WHEN NOT closed AND length(bare) < 80 AND o > 1 THEN 0 ELSE 1 END AS own FROM q), h AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY o) AS seq FROM f), m AS (SELECT *, count(*) OVER (PARTITION BY conv_id, seq) AS c FROM h)
 SELECT conv_id, CAST(seq AS INT) AS seq, string_agg(CASE WHEN c = 1 THEN body WHEN own = 1 THEN regexp_replace(body, '\\s+$', '') ELSE bare END, chr(10) ORDER BY o) AS body FROM m GROUP BY conv_id, seq""")
def session_chunks_greedy(spark, d):
    s = chunk.turns_to_sessions(t(spark, d, "conversations"))
    return chunk.explode_chunks(s, chunk.session_chunks(F.col("turns")), ["conv_id"]).select("conv_id", "seq", "body")


@query("WITH l AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'user' AND coalesce(text, '') <> ''), a AS (SELECT DISTINCT conv_id FROM conversations) SELECT a.conv_id, coalesce('[] ' || role || ': ' || substring(regexp_replace(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g'), 1, 80), '') AS tail FROM a LEFT JOIN l ON l.conv_id = a.conv_id AND r = 1")
def session_tail(spark, d):
    return chunk.turns_to_sessions(t(spark, d, "conversations")).select("conv_id", chunk.session_tail(F.col("turns")).alias("tail"))


QUESTIONS = ["清掃の集合場所はどこだっけ", "Pico Router 7 の設定", "みなと市民センターへの道", "the disgusting idiot", "???", "a b a"]


@query("SELECT * FROM (VALUES (1, '清掃,集合場所'), (2, 'Pico,Router,7,設定'), (3, 'みな,市民,センター,道'), (4, 'the,disgusting,idiot'), (5, '???'), (6, 'a,b')) v(id, terms)")
def split_query_terms(spark, d):
    q = spark.createDataFrame(list(enumerate(QUESTIONS, 1)), "id int, q string")
    return q.select("id", F.array_join(T.split_query_udf()(F.col("q")), ",").alias("terms"))


# ---- search

@query(f"WITH {FREQ} SELECT n, round(avgdl, 6) AS avgdl, n0, n1, n2, round(ln((n + 1) / (n1 + 1)), 6) AS idf1 FROM s")
def corpus_stats_df_idf(spark, d):
    s = index.matches(*indexed(spark, d)[1:], search.Query(TERMS).phrases)[1]
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), "n0", "n1", "n2", F.round(F.log((F.col("n") + 1) / (F.col("n1") + 1)), 6).alias("idf1"))


@query(f"WITH {WORDS} SELECT path, CAST(seq AS INT) AS seq, CAST(len(list_filter(range(1, len(words)), lambda i: words[i] = 'of' AND words[i + 1] = 'the')) AS INT) AS f FROM w WHERE len(list_filter(range(1, len(words)), lambda i: words[i] = 'of' AND words[i + 1] = 'the')) > 0")
def phrase_match(spark, d):
    return index.counted(indexed(spark, d)[1], [["of", "the"]]).select("path", "seq", F.col("f0").alias("f"))


@query(f"WITH {WORDS} SELECT path, CAST(seq AS INT) AS seq, x AS term, count(*) AS f FROM (SELECT path, seq, unnest(words) AS x FROM w) GROUP BY ALL")
def index_postings(spark, d):
    return index.postings(note_chunks(spark, d), repeated(spark, d)).select("path", "seq", "term", F.size("at").cast("long").alias("f"))


@query(f"WITH {BM25} SELECT path, CAST(seq AS INT) AS seq, round(bm25, 6) AS score FROM r ORDER BY round(bm25, 9) DESC, path, seq LIMIT 20")
def search_bm25_topk(spark, d):
    q = search.Query(TERMS)
    found, stats = index.matches(*indexed(spark, d)[1:], q.phrases)
    return search.ranked(found, q, most=20, stats=stats).select("path", "seq", F.round("bm25", 6).alias("score"))


HITS = "path, kind, CAST(seq AS INT) AS seq, CAST(nseq AS INT) AS nseq, body, score, coverage, rank"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("path", "kind", "seq", "nseq", "body", "score", "coverage", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_pipeline_sql()} SELECT {HITS} FROM res")
def search_full_pipeline(spark, d):
    return _hits(index.search_frames(*indexed(spark, d), search.Query(TERMS)))


@query(f"WITH {_pipeline_sql(True)} SELECT {HITS} FROM res")
def search_kind_weighted_recency(spark, d):
    return _hits(index.search_frames(*indexed(spark, d), search.Query(TERMS), recency_days=30.0, now=NOW))


@query(f"WITH {_pipeline_sql(k=10)} SELECT {HITS.replace('rank', 'row_number() OVER (ORDER BY rank) AS rank')} FROM res WHERE coverage >= 0.5 AND score >= 0.1")
def search_coverage(spark, d):
    return _hits(index.search_frames(*indexed(spark, d), search.Query(TERMS), top_k=10, min_coverage=0.5, min_score=0.1))


@query(f"WITH {_pipeline_sql(k=10)}, u AS (SELECT *, sum({EST.format(x='body')}) OVER (ORDER BY rank) AS used FROM res) SELECT {HITS} FROM u WHERE used <= 1500")
def search_token_budget(spark, d):
    return _hits(index.search_frames(*indexed(spark, d), search.Query(TERMS), top_k=10, budget=1500))


@query(f"WITH {_pipeline_sql(where=OF_TWO)} SELECT {HITS} FROM res")
def search_kinds(spark, d):
    """Of two kinds; the statistics are those of all."""
    return _hits(index.search_frames(*indexed(spark, d), search.Query(TERMS), kinds=["profile", "state"]))


@query(f"WITH {_pipeline_sql(k=10)}, x AS (SELECT *, {EST.format(x='body')} AS n, substring(body, 1, 404) AS h FROM res WHERE rank = 1), y AS (SELECT *, list_max(list_filter(range(0, length(h) + 1), lambda i: {EST.format(x='substring(h, 1, i)')} <= 99)) AS m FROM x) SELECT path, rank, CASE WHEN n <= 100 THEN body ELSE regexp_replace(substring(h, 1, m), '\\s+$', '') || '…' END AS body FROM y")
def search_budget_cuts_first(spark, d):
    """A budget under the first hit's length cuts it, and leaves out the others."""
    hits = index.search_frames(*indexed(spark, d), search.Query(TERMS), top_k=10, budget=100)
    return hits.select("path", F.col("rank").cast("long").alias("rank"), "body")


@query(f"WITH {_pipeline_sql(k=10)}, h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, rank) AS r FROM res) SELECT {HITS} FROM h WHERE r <= 2 ORDER BY score DESC, rank LIMIT 5")
def hints_two_per_kind(spark, d):
    return _hits(search.hints(index.search_frames(*indexed(spark, d), search.Query(TERMS), top_k=10)))


@query(f"WITH {CHUNKS} SELECT kind, count(*) AS count FROM chunks GROUP BY 1")
def index_stats_by_kind(spark, d):
    return index.by_kind(note_chunks(spark, d))


@query("SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def reminder_substring_anti(spark, d):
    """Commitments (items) whose text stands in no reminder (document): the items are checked to be few before they are sent along."""
    items, docs = t(spark, d, "benchmark"), t(spark, d, "documents").select(F.col("text").alias("raw"))
    if items.count() > 100_000:
        return items.join(docs, F.col("raw").contains(F.col("text")), "left_anti").select("item_id")
    found = docs.join(F.broadcast(items), F.col("raw").contains(F.col("text"))).select(F.col("item_id").alias("found")).distinct()
    return items.join(found, items.item_id == found.found, "left_anti").select("item_id")


@query("WITH a AS (SELECT 0 AS source_ord, 'session' AS kind, 'f' || conv_id AS path FROM conversations GROUP BY conv_id UNION ALL SELECT 1, 'note', 'f' || doc_id FROM documents UNION ALL SELECT 2, 'profile', 'f' || page_id FROM pages) SELECT path, min(source_ord) AS source_ord, min_by(kind, source_ord) AS kind FROM a GROUP BY 1")
def union_sources_first_path(spark, d):
    from tallystone.sources.corpus import first_path

    path = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("path")
    a = t(spark, d, "conversations").select("conv_id").distinct().select(F.lit(0).alias("source_ord"), F.lit("session").alias("kind"), path("conv_id"))
    b = t(spark, d, "documents").select(F.lit(1), F.lit("note"), path("doc_id"))
    c = t(spark, d, "pages").select(F.lit(2), F.lit("profile"), path("page_id"))
    return first_path(a.union(b).union(c)).select("path", "source_ord", "kind")


@query("WITH a AS (SELECT 's' || conv_id AS session_id, false AS archived, 'live/' || conv_id AS path FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id UNION ALL SELECT 's' || conv_id, true, 'archive/' || turn || '/' || conv_id FROM conversations) SELECT session_id, path, archived FROM a QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY archived, path) = 1")
def sessions_live_or_archived(spark, d):
    from tallystone.sources.corpus import prefer_live

    c = t(spark, d, "conversations")
    sid = F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id")
    live = c.where("conv_id % 3 <> 0").select("conv_id").distinct().select(sid, F.lit(False).alias("archived"), F.concat(F.lit("live/"), F.col("conv_id").cast("string")).alias("path"))
    old = c.select(sid, F.lit(True), F.concat(F.lit("archive/"), F.col("turn").cast("string"), F.lit("/"), F.col("conv_id").cast("string")))
    return prefer_live(live.union(old)).select("session_id", "path", "archived")


@query("SELECT page_id, substring(regexp_replace(trim(html, chr(32) || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g'), 1, 90) AS snippet FROM pages")
def page_snippets(spark, d):
    return t(spark, d, "pages").select("page_id", search.snippet("html").alias("snippet"))


@query("WITH l AS (SELECT conv_id, turn, '[' || coalesce(role, '?') || '] ' || substring(coalesce(text, ''), 1, 100) AS line FROM conversations) SELECT 'e' || conv_id AS episode_id, 'EPISODE_ID: e' || conv_id || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS payload FROM l GROUP BY conv_id")
def episode_payloads(spark, d):
    from tallystone.operators.extract import payloads

    s = chunk.turns_to_sessions(t(spark, d, "conversations")).select(F.col("conv_id").cast("string").alias("path"), "turns")
    e = s.select(F.lit(0).alias("pos"), F.concat(F.lit("e"), "path").alias("episode_id"), F.struct("path", F.array(F.lit(0), F.size("turns")).alias("turn_range")).alias("source"))
    return payloads(e, s, 100).select("episode_id", "payload")


@query(f"WITH c AS ({SQL['session_chunks_greedy']}), tails AS ({SQL['session_tail']}), n AS (SELECT conv_id, seq, count(*) OVER (PARTITION BY conv_id) AS nseq FROM c) SELECT conv_id, seq FROM n JOIN tails USING (conv_id) WHERE tail <> '' AND seq > 0 AND seq < nseq")
def session_chunks_with_more_to_come(spark, d):
    s = chunk.turns_to_sessions(t(spark, d, "conversations")).withColumns({"tail": chunk.session_tail(F.col("turns")), "kind": F.lit("session")})
    return chunk.explode_chunks(s, chunk.session_chunks(F.col("turns")), ["conv_id", "kind", "tail"]).where(search.mid_session()).select("conv_id", "seq")


@query("SELECT conv_id, count(*) AS turns, coalesce(sum(length(text)), 0) AS chars, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1")
def sessions_from_json(spark, d):
    """Each conversation as a session's file, read back."""
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))).alias("text"))
    turns = c.select("conv_id", F.explode(corpus.as_turns(F.concat(F.lit(" "), "text"))).alias("x"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.sum(F.length("x.content")), F.lit(0)).cast("long").alias("chars"), F.count_if(F.col("x.role") == "user").alias("users"))


@query(f"WITH {LEDGER} SELECT id, min_by(canonical_name, pos) AS canonical_name FROM ent GROUP BY 1")
def ledger_first_by_id(spark, d):
    e = ledger(spark, d)
    twice = e.union(e.select("id", F.lit("later").alias("canonical_name"), "aliases", "confusable_with", F.col("pos") + 10_000))
    return registry.first_by_id(twice).select("id", "canonical_name")


# ---- the engine itself, in a home made of the tables

@query(f"WITH {EVENTS} SELECT type, at, writer, CAST(pos AS VARCHAR) AS id FROM ev WHERE type IN ('click', 'purchase') AND ts >= TIMESTAMP '2000-01-01'")
def log_bulk_append_and_read(spark, d):
    """Events appended in bulk by executors and in a file by the driver, read back by type and time."""
    folder, new = scratch(spark, "log", d)
    if new:
        e = events(spark, d).select(F.col("pos").cast("string").alias("id"), "type", "at", "writer")
        one = e.orderBy(F.col("id").cast("long")).first().asDict()
        log.append(folder, one)
        log.append_frame(e.where(F.col("id") != one["id"]), folder)
    return log.read(spark, folder, ["click", "purchase"], "2000-01-01T00:00:00Z").select("type", "at", "writer", "id")


def write_sessions(sessions: DataFrame, folder: Path) -> int:
    """Files of conversations, written by executors; every third stands in the archive."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, turns in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turns"))):
                text = json.dumps([{"role": r["role"], "content": r["content"]} for r in turns]).encode()
                file = folder / "archive" / "2024-01" / f"{c}.json.gz" if c % 3 == 0 else folder / f"{c}.json"
                file.write_bytes(gzip.compress(text) if c % 3 == 0 else text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return sessions.select("conv_id", "turns").mapInArrow(written, "files long").agg(F.sum("files")).first()[0] or 0


def home(spark: SparkSession, d: str) -> Config:
    """A home whose sessions are the conversations (a third of them archived) and whose notes are the benchmark's items, ingested, extracted and reviewed.

    The model is a rule: an episode of conversation c names topic c % 20; of topics 3 and 7 it isn't sure, and topic 19 it leaves out.
    Every note promises its item; every third one has a reminder. Then topic 3 is approved, topic 7 rejected, and deferred proposals drained.
    """
    folder, new = scratch(spark, "home", d)
    cfg = Config(folder, max_episodes_per_run=sys.maxsize, reminders_file=folder / "reminders.json").ensure_dirs()
    if not new:
        return cfg
    (cfg.sessions / "archive" / "2024-01").mkdir(parents=True)
    write_sessions(chunk.turns_to_sessions(t(spark, d, "conversations")), cfg.sessions)
    keys = []
    for r in t(spark, d, "benchmark").toLocalIterator():
        (cfg.notes / f"{r.item_id}.md").write_text(r.text or "")
        keys += [f"item-{r.item_id:08}"] * (r.item_id % 3 == 0)
    cfg.reminders_file.write_text(json.dumps([{"title": k} for k in keys]))

    def model(prompt: str, payload: str) -> dict:
        if prompt == extract.COMMITMENT_PROMPT:
            (item,) = re.findall(r"^FILE: (\d+)\.md$", payload, re.M)
            return {"commitments": [{"key": f"item-{int(item):08}", "text": item}]}
        found = [(id, int(c) % 20) for id, c in re.findall(r"^EPISODE_ID: (ep_(\d+)_\S+)$", payload, re.M)]
        return {"episodes": [{"episode_id": id, "entities": [{"name": f"Topic {k:02}", "type": "thing", "confidence": "low" if k in (3, 7) else "high"}]} for id, k in found if k != 19]}

    out = io.StringIO()
    ingest.run(spark, cfg, backfill=True, out=out)
    extract.run(spark, cfg, model, out=out)
    for p in review.rows(spark, cfg, every=False, kind="entity"):
        review.approve(spark, cfg, p["proposal_id"]) if p["name"] == "Topic 03" else review.reject(spark, cfg, p["proposal_id"])
    review.drain(spark, cfg, "review", cfg.max_proposals_per_run)
    return cfg


@query(f"WITH {SESSION} SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'sessions/archive/2024-01/' || conv_id || '.json.gz' ELSE 'sessions/' || conv_id || '.json' END AS path, count(*) AS \"end\", 'ep_' || conv_id || '_0-' || count(*) || '_' || substring(sha256(string_agg(p, chr(30) ORDER BY turn)), 1, 16) AS episode_id FROM parts GROUP BY conv_id")
def engine_ingest_run(spark, d):
    e = log.read(spark, home(spark, d).events, ["episode_added"])
    return e.select("source.session_id", "source.path", F.col("source.turn_range")[1].cast("long").alias("end"), "episode_id")


RUN = """c AS (SELECT DISTINCT conv_id, conv_id % 20 AS k FROM conversations), g AS (SELECT k, count(*) AS n FROM c GROUP BY 1), good AS (SELECT k FROM g WHERE k NOT IN (3, 7, 19) AND n >= 3),
 x AS (SELECT (SELECT count(*) FROM c) AS eps, (SELECT count(*) FROM good) AS good, (SELECT count(*) FROM g WHERE k = 3) AS three, (SELECT count(*) FROM g WHERE k = 7) AS seven, (SELECT count(*) FROM benchmark) AS notes, (SELECT count(*) FROM benchmark WHERE item_id % 3 <> 0) AS m)"""


@query(f"""WITH {RUN}, r AS (SELECT unnest([{{'type': 'episode_added', 'n': eps}}, {{'type': 'entity_scanned', 'n': eps}}, {{'type': 'entity_candidate_seen', 'n': (SELECT count(*) FROM c WHERE k NOT IN (3, 7, 19))}}, {{'type': 'entity_proposed', 'n': good}}, {{'type': 'entity_confirmed', 'n': good + three}},
 {{'type': 'proposal_resolved', 'n': three + seven}}, {{'type': 'proposal_opened', 'n': three + seven + least(m, 10) + least(greatest(m - 10, 0), 10)}}, {{'type': 'proposal_deferred', 'n': greatest(m - 10, 0)}}, {{'type': 'commitment_scanned', 'n': notes}}]) AS v FROM x) SELECT v.type AS type, v.n AS n FROM r WHERE v.n > 0""")
def engine_extract_run(spark, d):
    return log.read(spark, home(spark, d).events).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {RUN} SELECT 'thing:topic_' || lpad(CAST(k AS VARCHAR), 2, '0') AS id, 'Topic ' || lpad(CAST(k AS VARCHAR), 2, '0') AS canonical_name, true AS saved FROM g WHERE k = 3 OR k IN (SELECT k FROM good)")
def engine_ledger_replay(spark, d):
    """The ledger folded from the log, and whether the files that the run kept say the same."""
    cfg = home(spark, d)
    kept = {e["id"]: e["canonical_name"] for e in registry.Ledger.load(cfg.registry).entities}
    rows = [(e["id"], e["canonical_name"], kept.get(e["id"]) == e["canonical_name"]) for e in registry.replay(log.read(spark, cfg.events)).entities]
    return spark.createDataFrame(rows, "id string, canonical_name string, saved boolean")


@query(f"""WITH {RUN}, i AS (SELECT item_id, row_number() OVER (ORDER BY CAST(item_id AS VARCHAR) || '.md') AS r FROM benchmark WHERE item_id % 3 <> 0)
 SELECT 'entity' AS kind, 'Topic ' || lpad(CAST(k AS VARCHAR), 2, '0') AS what, CASE k WHEN 3 THEN 'approved' ELSE 'rejected' END AS state FROM g WHERE k IN (3, 7) UNION ALL SELECT 'commitment', 'item-' || lpad(CAST(item_id AS VARCHAR), 8, '0'), CASE WHEN r <= 20 THEN 'queued' ELSE 'deferred' END FROM i""")
def engine_proposals(spark, d):
    return review.frame(spark, home(spark, d)).select("kind", F.coalesce("name", "key").alias("what"), "state")
