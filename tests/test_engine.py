"""The engine over a home directory: log, ingestion, extraction, review, index and search."""

import gzip
import json
import math
import sqlite3
import sys

import pytest
from pyspark.sql import functions as F

from tallystone.cli import main
from tallystone.config import Config
from tallystone.functions import text
from tallystone.operators import chunk, extract, index, ingest, projections, registry, review, search
from tallystone.sources import corpus, log


@pytest.fixture
def cfg(tmp_path):
    made = Config.load(tmp_path / "home")
    return made.ensure_dirs()


def session(cfg, name, contents, archived=None, at="2031-05-04T09:00:00+09:00"):
    turns = [c if isinstance(c, dict) else {"role": "user", "content": c, "timestamp": at} for c in contents]
    if archived:
        folder = cfg.sessions / "archive" / archived
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(turns).encode()))
    else:
        (cfg.sessions / f"{name}.json").write_bytes(json.dumps(turns).encode())


def events(spark, cfg, *types):
    return [r.asDict(recursive=True) for r in log.with_position(log.read(spark, cfg.events, list(types) or None)).orderBy("pos").collect()]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


# ---- text

@pytest.mark.parametrize("x,y", [("Pico Router 7", "pico router 7"), ("清掃", "清掃"), ("集合場所", "集合 合場 場所"), ("駅A-1.b", "駅 a-1.b"), ("", "")])
def test_bigramize(spark, x, y):
    assert one(spark, text.bigramize("x"), x) == y


def test_split_query():
    terms = text.split_query("清掃の集合場所はどこだっけ")
    assert terms == ["清掃", "集合場所"]
    assert text.split_query("???") == ["???"] and text.split_query("a b a") == ["a", "b"]


@pytest.mark.parametrize("x", ["", "abc", "清掃" * 30, "a b " * 100, "a清 " * 40])
def test_token_estimate_and_cut(spark, x):
    size = lambda s: sum(c.isascii() for c in s) // 4 + sum(not c.isascii() for c in s)
    assert one(spark, text.estimate_tokens("x"), x) == size(x)
    got = one(spark, text.truncate_to_tokens("x", 12), x)
    want = x if size(x) <= 12 else max((x[:n] for n in range(len(x) + 1) if size(x[:n]) <= 11), key=len).rstrip() + "…"
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 1500, 1501, 2800, 2801, 5000])
def test_windows(spark, n):
    x = "".join(chr(97 + i % 26) for i in range(n))
    want, s = [], 0
    while True:
        want.append(x[s : s + 1500])
        if s + 1500 >= n:
            break
        s += 1300
    assert one(spark, text.split_long("x"), x) == want


def test_names(spark):
    assert one(spark, text.normalize("x"), " A　b C ") == "abc"
    assert one(spark, text.slugify("x"), "Pico Router-7!") == "pico_router_7"
    assert one(spark, text.slugify("x"), "山") == "e" + __import__("hashlib").sha256("山".encode()).hexdigest()[:10]


def test_sql_functions(spark):
    text.register(spark)
    r = spark.sql("SELECT ts_normalize(' A b') a, ts_slugify('A b') b, ts_estimate_tokens('abcd清') c, ts_bigramize('集合場所 X') d, ts_split_query('清掃のX') e").first()
    assert tuple(r) == ("ab", "a_b", 2, "集合 合場 場所 x", ["清掃", "X"])


def test_markdown(spark):
    long = "x" * 100
    doc = f"before {long}\n## One\n{long}\n### two #\nshort\n##### no heading {long}\n# End\n"
    got = [(p.section, p.body) for p in one(spark, chunk.markdown_chunks(F.col("x")), doc)]
    assert [s for s, _ in got] == ["", "One", "two #"] and got[2][1].endswith("\n# End")
    assert one(spark, chunk.markdown_chunks(F.col("x")), "  \n ") == [] and len(one(spark, chunk.markdown_chunks(F.col("x")), "tiny")) == 1


def test_session_chunks_and_tail(spark):
    turns = [("user", "q" * 700, "2031-05-04T09:00:00Z"), ("assistant", "", "2031-05-04T09:01:00Z"), ("assistant", "a" * 900, "2031-05-04T09:02:00Z"), ("user", "last", "2031-06-01T00:00:00Z")]
    df = spark.createDataFrame([(turns,)], f"t {corpus.TURNS}")
    got = df.select(chunk.session_chunks(F.col("t")).alias("c"), chunk.session_tail(F.col("t")).alias("z")).first()
    assert [c.section for c in got.c] == ["2031-05-04", "2031-05-04"] and got.c[-1].body.endswith("\n[2031-06-01T00:00] user: last")
    assert got.z.startswith("[2031-05-04T09:02] assistant: aaa") and len(got.z.split(": ", 1)[1]) == 80


# ---- log

def test_log(spark, cfg):
    with pytest.raises(log.InvalidEvent):
        log.append(cfg.events, {"type": "x", "at": "2031-05-01T00:00:00Z", "writer": ""})
    e = {"type": "x", "at": "2031-05-31T23:00:00-05:00", "writer": "w", "name": "清"}
    log.append(cfg.events, e)
    assert "id" not in e
    log.emit(cfg.events, "y", "w", at="2031-07-09T00:00:00Z", name="b")
    log.emit(cfg.events, "x", "w", at="2031-06-30T00:00:00", name="c")
    with open(cfg.events / "2031-06.jsonl", "ab") as f:
        f.write(b'{"bad\n\n["list"]\n"text"\n\xff\xfe\n')
    assert sorted(p.stem for p in cfg.events.glob("*.jsonl")) == ["2031-05", "2031-06", "2031-07"]
    assert [r["name"] for r in events(spark, cfg)] == ["清", "c", "b"]
    assert [r["name"] for r in events(spark, cfg, "x")] == ["清", "c"]
    assert log.read(spark, cfg.events, []).count() == 0 and log.read(spark, cfg.home / "no").count() == 0
    assert [r.name for r in log.read(spark, cfg.events, since="2031-06-01T03:59:00Z").orderBy("file").collect()] == ["清", "c", "b"]
    assert [r.name for r in log.read(spark, cfg.events, since="2031-06-01T04:01:00Z").orderBy("file").collect()] == ["c", "b"]


def test_log_order_over_blocks(spark, cfg):
    log.append(cfg.events, *({"type": "x", "at": "2031-05-01T00:00:00Z", "writer": "w", "name": str(i)} for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r["name"] for r in events(spark, cfg)] == [str(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- ingestion

def test_ingest(spark, cfg):
    session(cfg, "a", ["one", "two"])
    assert ingest.run(spark, cfg, dry_run=True) == 0 and not events(spark, cfg)
    assert ingest.run(spark, cfg) == 0 and ingest.run(spark, cfg) == 0
    session(cfg, "a", "one two three".split())
    (cfg.sessions / "broken.json").write_text("{not json")
    session(cfg, "odd", ["fine", "x"])
    (cfg.sessions / "odd.json").write_text('[{"role": "user", "content": "x"}, 5]')
    assert ingest.run(spark, cfg) == 0
    got = events(spark, cfg, "episode_added")
    assert [e["source"]["turn_range"] for e in got] == [[0, 2], [2, 3]]
    h = __import__("hashlib").sha256("user\0one\x1euser\0two".encode()).hexdigest()[:16]
    assert got[0]["episode_id"] == f"ep_a_0-2_{h}" and got[0]["source"]["path"] == "sessions/a.json"


def test_ingest_archive(spark, cfg, capsys):
    session(cfg, "a", ["one"], archived="2031-01")
    session(cfg, "b", ["x"], archived="2031-03")
    session(cfg, "b", ["x", "y"])
    assert ingest.run(spark, cfg) == 1
    err = capsys.readouterr().err
    assert "2031-02" in err and "1 session(s) come from the archive" in err
    assert sorted(e["source"]["turn_range"][1] for e in events(spark, cfg, "episode_added")) == [1, 2]
    (cfg.sessions / "b.json").unlink()
    (cfg.sessions / "archive/2031-03/b.json.gz").unlink()
    assert ingest.run(spark, cfg) == 1 and "session b" in capsys.readouterr().err


def test_stream(spark, cfg, tmp_path):
    from tallystone.streaming.ingest import start

    session(cfg, "a", ["one"])
    start(spark, cfg, str(tmp_path / "cp")).awaitTermination()
    start(spark, cfg, str(tmp_path / "cp2")).awaitTermination()
    assert len(events(spark, cfg, "episode_added")) == 1


# ---- extraction and review

def seeing(**names):
    """A model that finds the names whose text stands in an episode."""

    def model(prompt, payload):
        if "FILE:" in payload:
            return {"commitments": [{"text": "pay", "date_hint": "May", "key": "pay-rent"}, {"text": "x", "key": "known"}]}
        out = []
        for block in payload.split("EPISODE_ID: ")[1:]:
            id, _, body = block.partition("\n")
            out.append({"episode_id": id.strip(), "entities": [{"name": n, "type": "thing", "aliases": [], "context": "c", **v} for n, v in names.items() if n.lower() in body.lower()]})
        return {"episodes": out}

    return model


def test_extract(spark, cfg):
    for i in range(4):
        session(cfg, f"s{i}", [f"the Gizmo and Gizmoid{' and Maybe' if i == 3 else ''}"])
    (cfg.notes / "n.md").write_text("rent is due in May")
    cfg.reminders_file = cfg.home / "r.json"
    cfg.reminders_file.write_text('{"x": [{"title": "kn\\u006fwn"}]}')
    ingest.run(spark, cfg)
    model = seeing(Gizmo={}, Gizmoid={}, Maybe={"confidence": "low"})
    assert extract.run(spark, cfg, model, dry_run=True) == 0 and not events(spark, cfg, "entity_scanned")
    assert extract.run(spark, cfg, model) == 0
    assert [e["name"] for e in events(spark, cfg, "entity_confirmed")] == ["Gizmo"]
    raised = {e["name"] or e["key"]: e for e in events(spark, cfg, "proposal_opened")}
    assert set(raised) == {"Gizmoid", "Maybe", "pay-rent"} and raised["Gizmoid"]["collides_with"] == "thing:gizmo"
    n = len(events(spark, cfg))
    assert extract.run(spark, cfg, model) == 0 and len(events(spark, cfg)) == n
    id = raised["Gizmoid"]["proposal_id"]
    assert review.approve(spark, cfg, id) == {"proposal_id": id, "kind": "entity", "entity_id": "thing:gizmoid"}
    with pytest.raises(review.ReviewError):
        review.reject(spark, cfg, id)
    ledger = registry.Ledger.load(cfg.registry)
    assert ledger.by_id("thing:gizmo")["confusable_with"] == ["thing:gizmoid"] and ledger.by_id("thing:gizmoid")["confusable_with"] == ["thing:gizmo"]
    review.approve(spark, cfg, raised["Maybe"]["proposal_id"], merge_into="thing:gizmo")
    review.reject(spark, cfg, raised["pay-rent"]["proposal_id"])
    saved = {p.name: p.read_text() for p in cfg.registry.glob("*.json")}
    registry.replay(log.read(spark, cfg.events)).save(cfg.registry)
    assert {p.name: p.read_text() for p in cfg.registry.glob("*.json")} == saved
    assert review.rows(spark, cfg, every=False) == [] and len(review.rows(spark, cfg)) == 3


def test_budget_and_drain(spark, cfg):
    session(cfg, "a", ["n1 n2 n3 n4 n5"])
    ingest.run(spark, cfg)
    cfg.max_proposals_per_run = 3
    model = seeing(**{f"n{i}": {"confidence": "low"} for i in range(1, 6)})
    extract.run(spark, cfg, model, skip_commitments=True)
    assert len(events(spark, cfg, "proposal_opened")) == 3 and len(events(spark, cfg, "proposal_deferred")) == 2
    extract.run(spark, cfg, model, skip_commitments=True)
    assert len(events(spark, cfg, "proposal_opened")) == 5
    assert [p["name"] for p in review.rows(spark, cfg, every=False)] == [f"n{i}" for i in range(1, 6)]


def test_failures(spark, cfg, capsys):
    for i in range(3):
        session(cfg, f"s{i}", ["x"])
    ingest.run(spark, cfg)
    cfg.episodes_per_batch, cfg.max_consecutive_failures = 1, 2
    cfg.llm_cmd = f'{sys.executable} -c "print(1)"'
    assert extract.run(spark, cfg) == 1 and not events(spark, cfg, "entity_scanned") and "failed in a row" in capsys.readouterr().err
    cfg.llm_cmd = None
    with pytest.raises(ValueError):
        extract.run(spark, cfg)
    assert extract.first_object('a {"x": 1} b {"y": 2}') == {"x": 1} and extract.first_object("none") is None
    assert not extract.answer_is("episodes", {"episodes": [3]}) and not extract.answer_is("commitments", {"commitments": {}})


# ---- index and search

def fts5(rows, phrases):
    """SQLite's full-text index as a second opinion."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='unicode61 remove_diacritics 0')")
    con.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", rows)
    q = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
    return dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (q,)))


def test_bm25_and_postings_against_fts5(spark, cfg):
    words = ["清掃の集合場所は東広場", "集合場所と清掃", "router seven pico", "Pico router 7 and pico Router 7", "清掃清掃清掃", "other text entirely"] + [f"filler {i} text" for i in range(20)]
    rows = [(f"p{i}", "note", "", w, 1, 1, 0.0, "") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "path string, kind string, section string, body string, seq int, nseq int, mtime double, tail string")
    q = search.Query(["清掃", "集合場所", "pico router"])
    q = search.Query(q.terms)
    assert q.phrases == [["清掃"], ["集合", "合場", "場所"], ["pico", "router"]]
    ex = [(i, r.y) for i, r in enumerate(df.select(text.bigramize("body").alias("y")).collect())]
    want = fts5(ex, q.phrases)
    got = {int(r.path[1:]): r.bm25 for r in search.ranked(df, q).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    scan = search.counts(search.tokenised(df), q.phrases).where("f0 + f1 + f2 > 0").select("path", "f0", "f1", "f2")
    by = index.counted(index.postings(df), q.phrases).select("path", "f0", "f1", "f2")
    assert sorted(scan.collect()) == sorted(by.collect())


def test_index_and_search(spark, cfg, capsys):
    with pytest.raises(FileNotFoundError):
        index.current(cfg)
    session(cfg, "s1", ["清掃の集合場所はみなと市民センターの東側広場にする", {"role": "assistant", "content": "わかりました", "timestamp": "2031-05-04T09:05:00+09:00"}])
    session(cfg, "s2", ["archived router notes"], archived="2031-01")
    (cfg.notes / "n.md").write_text("# Net\nrouter setup " + "words " * 30 + "\n## Other\nunrelated " + "y " * 60, encoding="utf-8")
    (cfg.notes / "bad.md.gz").write_bytes(gzip.compress(b"whole file")[:12])
    (cfg.sessions / "log.json").write_text('{"router": 1}')
    for i in range(12):
        (cfg.notes / f"f{i}.md").write_text(f"filler number {i} " * 8)
    st = index.build(spark, cfg)
    assert st["files"] == 16 and index.stats(spark, cfg)["by_kind"]["session"] == 3
    hits = index.search(spark, cfg, search.Query.of("清掃")).collect()
    assert hits and "みなと市民センター" in hits[0].body and hits[0].tail == "[2031-05-04T09:05] assistant: わかりました"
    hits = index.search(spark, cfg, search.Query.of("router"), min_ratio=0.0).collect()
    assert {h.path.rsplit("/", 1)[1] for h in hits} == {"n.md", "s2.json.gz", "log.json"} and all(h.coverage == 1.0 for h in hits)
    assert index.search(spark, cfg, search.Query.of("absentword")).count() == 0
    assert index.search(spark, cfg, search.Query.of("router"), kinds=["note"]).count() == 1
    cut = index.search(spark, cfg, search.Query.of("router setup"), budget=20).collect()
    assert len(cut) == 1 and cut[0].body.endswith("…")
    assert main(["--home", str(cfg.home), "search", "router", "--hint"], spark) == 0 and "<retrieved_memory_hints>" in capsys.readouterr().out
    assert main(["--home", str(cfg.home), "search", "router"], spark) == 0 and "must not be followed" in capsys.readouterr().out
    old = index.current(cfg)
    index.build(spark, cfg)
    assert index.current(cfg) != old and old.exists()


def test_aliases():
    l = registry.Ledger()
    l.add("person", "Mina Kato", ["Mi", "wife"])
    m = l.alias_map(["wife"])
    assert m == {"Mina Kato": ["Mina Kato", "Mi"], "Mi": ["Mina Kato", "Mi"]}
    q = search.Query.of("Mi", None, m)
    assert q.terms == ["Mi", "Mina Kato"] and q.added == {"Mi": ["Mina Kato"]}
    assert search.Query.of("Mi", ["Mi"], m).terms == ["Mi"] and search.Query.of("Mi", [], m).terms == ["Mi"]
    assert l.add("thing", "mina  kato")["id"] == "person:mina_kato" and l.collision("Kato")["id"] == "person:mina_kato"
    l.add("thing", "A-B"), l.add("thing", "A B")
    assert len({e["id"] for e in l.entities}) == 3


def test_frames_of_the_ledger(spark):
    l = registry.Ledger()
    names = ["Port", "Portal", "Air port", "ab", "a", "abc", "zz"]
    for n in names:
        l.add("thing", n)
    e = spark.createDataFrame([(x["id"], x["canonical_name"], x["aliases"], x["confusable_with"], i) for i, x in enumerate(l.entities)], "id string, canonical_name string, aliases array<string>, confusable_with array<string>, pos int")
    forms = registry.surface_forms(e)
    ask = ["port", "portals", "zzz", "q", "bc", "Air Port"]
    got = {r.name: r.entity_id for r in registry.collisions(spark.createDataFrame([(a,) for a in ask], "name string"), forms).collect()}
    assert got == {a: c["id"] for a in ask if (c := l.collision(a))}
    found = {r.name: r.entity_id for r in registry.lookup(spark.createDataFrame([(a,) for a in ask], "name string"), forms).collect()}
    assert found == {a: (l.find(a) or {}).get("id") for a in ask}


def test_cli_and_config(cfg, spark, capsys, monkeypatch):
    assert main(["--home", str(cfg.home), "init"]) == 0
    session(cfg, "a", ["hello"])
    assert main(["--home", str(cfg.home), "ingest"], spark) == 0
    assert main(["--home", str(cfg.home), "review", "list"], spark) == 0 and "nothing waits" in capsys.readouterr().out
    assert main(["--home", str(cfg.home), "review", "show", "nope"], spark) == 1
    assert main(["--home", str(cfg.home), "search", "x"], spark) == 1
    assert main(["--home", str(cfg.home), "reindex"], spark) == 0 and main(["--home", str(cfg.home), "reindex", "--stats"], spark) == 0
    assert main(["--home", str(cfg.home), "rebuild-registry"], spark) == 0
    (cfg.home / "config.json").write_text('{"llm_retries": 7, "later": 1, "extra_sources": [{"path": "more"}]}')
    monkeypatch.setenv("TALLYSTONE_MODEL_CMD", "m")
    c = Config.load(cfg.home, llm_timeout_sec=None)
    assert (c.llm_retries, c.llm_timeout_sec, c.llm_cmd, c.extra_sources[0].path) == (7, 180, "m", cfg.home / "more")
    (cfg.home / "config.json").write_text("{")
    with pytest.raises(ValueError):
        Config.load(cfg.home)


def test_drain_leaves_decided(spark):
    rows = [("proposal_deferred", "a", 1), ("proposal_deferred", "b", 2), ("proposal_deferred", "c", 3), ("proposal_opened", "a", 4), ("proposal_resolved", "b", 5)]
    df = spark.createDataFrame(rows, "type string, proposal_id string, pos long")
    assert [r.proposal_id for r in projections.to_drain(df, 9).collect()] == ["c"]


def test_small_files_are_read_many_a_task(spark, cfg):
    for i in range(60):
        session(cfg, f"s[{i}]", [f"turn {i}"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        files = corpus.list_files(spark, corpus.default_sources(cfg))
        assert files.rdd.getNumPartitions() <= 4 and files.count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.session_id for r in corpus.sessions(spark, cfg).where("size(turns) = 1 and not archived").collect()} == {f"s[{i}]" for i in range(60)}


def test_extraction_writes_a_batch_at_once_and_takes_its_work_in_order(spark, cfg, monkeypatch):
    cfg.episodes_per_batch, cfg.max_episodes_per_run = 2, 4
    for i in range(6):
        session(cfg, f"s{i}", [f"turn {i}"])
    monkeypatch.setattr(ingest, "A_WRITE", 4)
    assert ingest.run(spark, cfg) == 0 and len(events(spark, cfg, "episode_added")) == 6
    monkeypatch.setattr(extract, "FEW", 1)
    writes, append = [], log.append
    monkeypatch.setattr(log, "append", lambda folder, *e: writes.append([x["type"] for x in e]) or append(folder, *e))
    asked = []

    def model(prompt, payload):
        ids = [x.split(": ")[1] for x in payload.splitlines() if x.startswith("EPISODE_ID: ")]
        asked.append(ids)
        return {"episodes": [{"episode_id": i, "entities": [{"name": "Router", "type": "thing", "confidence": "high"}]} for i in ids]}

    extract.run(spark, cfg, model, skip_commitments=True)
    seen, done = ["entity_candidate_seen"], ["entity_scanned"]
    assert [[i.split("_")[1] for i in ids] for ids in asked] == [["s0", "s1"], ["s2", "s3"]]
    assert writes == [seen * 2 + done * 2] * 2 + [["entity_proposed", "entity_confirmed"]]
    extract.run(spark, cfg, model, skip_commitments=True)
    assert [i.split("_")[1] for i in asked[2]] == ["s4", "s5"] and len(asked) == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_take_no_shuffle_and_repeated_chunks_are_merged(spark):
    rows = spark.createDataFrame([("a", 1, "x Y x straße, 清掃の", "note"), ("b", 1, None, "note"), ("c", 2, "", "state"), ("a", 2, "x", "note")], "path string, seq int, body string, kind string")
    assert "Exchange" not in _plan(index.postings(rows))
    got = {(r.path, r.seq, r.term): (r.dl, r["at"]) for r in index.postings(rows).collect()}
    words = ["x", "y", "x", "stra", "ß", "e", "清掃", "掃の"]
    assert got == {("a", 1, w): (8, [i for i, v in enumerate(words) if v == w]) for w in words} | {("a", 2, "x"): (1, [0])}
    twice = index.postings(rows.union(rows), repeated=True)
    assert {(r.path, r.seq, r.term): r["at"] for r in twice.collect()}[("a", 1, "x")] == [0, 0, 2, 2] and twice.count() == len(got)
    for t in ("x Y x straße, 清掃の", "é² Ⅷ 😀😀x İ ΑΣ a_b-c.d", ""):
        assert text.words_of(one(spark, F.lower("x"), t)) == one(spark, text.tokens("x"), t)


def test_search_opens_its_terms_buckets_and_moves_no_bodies(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", "note" if i % 2 else "state", "", f"router number{i} of the house", 1, 1, 1.0, "") for i in range(40)], "path string, kind string, section string, body string, seq int, nseq int, mtime double, tail string")
    index.write(rows, str(tmp_path / "made"))
    chunks, postings, stats = index.tables(spark, tmp_path / "made")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = index.search_frames(chunks, postings, stats, search.Query(["number7", "of the"]), kinds=["note"], min_ratio=0.0)
        assert "SortMergeJoin" not in _plan(hits)
        assert [r.path for r in hits.collect()] == ["p7", "p1", "p11", "p13", "p15"] and stats.first().avgdl == 5.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "bucket" in _plan(index.counted(postings, [["of", "the"]])).split("PartitionFilters")[1].split("]")[0]
    index.write(rows.withColumn("body", F.lit("?!")), str(tmp_path / "none"))
    assert index.search_frames(*index.tables(spark, tmp_path / "none"), search.Query(["router"])).count() == 0
