import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import corpus, series
from graphloom.operators.orphans import OrphanTracker, deletions, parents, references, track
from graphloom.providers import chain, extracted, translated, with_retry
from graphloom.sources import readers, sinks
from graphloom.streaming.incremental import GraphBuilder
from graphloom.streaming.sessions import SessionMemory, contexts, stream_contexts
from tests.toy import toy_graph


def test_news_json_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "n.json"
    f.write_text("﻿" + json.dumps([{"Title": "A", "Content": "x" * 2000, "Date": "2024-01-01"}, {"Title": "B", "Content": "", "Date": None}]), encoding="utf-8")
    rows = readers.read_news_json(spark, str(f)).withColumn("seq", F.monotonically_increasing_id())
    out = readers.news_sections(rows, "seq").collect()
    assert len(out) == 1 and out[0]["section"].startswith("[2024-01-01] A\n") and len(out[0]["section"]) == 15 + 1200
    f.write_text(json.dumps({"Title": "one", "Content": "c"}))
    assert readers.read_news_json(spark, str(f)).count() == 1


def test_news_csv(spark, tmp_path):
    f = tmp_path / "n.csv"
    f.write_text('Title,Content,Date,URL\nA,"two\nlines, ""quoted""",2024-01-01,u\n')
    assert readers.read_news_csv(spark, str(f)).first()["Content"] == 'two\nlines, "quoted"'


def test_price_files(spark, tmp_path):
    (tmp_path / "TCS.csv").write_text(" date ,CLOSE,Volume\n2024-01-02,10.5,100\n2024-01-01,bad,5\n")
    (tmp_path / "INDEX.csv").write_text("Date,Close,Volume\n2024-01-01,1,1\n")
    rows = readers.read_prices(spark, str(tmp_path / "TCS.csv")).orderBy("Date").collect()
    assert [(r["ticker"], str(r["Date"]), r["Close"]) for r in rows] == [("TCS", "2024-01-01", None), ("TCS", "2024-01-02", 10.5)]
    assert readers.read_prices(spark, str(tmp_path / "INDEX.csv"), skip=["index"]).count() == 0


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` close ` int, `Close Price` int, other int")
    assert series.standardise_headers(df).columns == ["Close", "other"]


def test_graph_json(spark, tmp_path):
    f = tmp_path / "g.json"
    f.write_text(json.dumps({"entities": [{"id": "a", "name": "A", "type": "Company"}, {"id": "b", "type": "Odd"}], "relationships": [{"subject": {"id": "a"}, "object": {"id": "b"}, "predicate": "x"}]}))
    g = readers.read_graph_json(spark, str(f))
    assert {(r["id"], r["name"], r["label"]) for r in g.nodes.collect()} == {("a", "A", "Company"), ("b", "b", "Indicator")}
    assert g.edges.first()["eid"] == "a|x|b"
    f.write_text(json.dumps({"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "a", "type": "t"}]}))
    assert readers.read_graph_json(spark, str(f)).edges.first()["rel"] == "t"


def test_graph_round_trip(spark, tmp_path):
    g = toy_graph(spark)
    target = sinks.write_graph(g, str(tmp_path), "v1")
    back = sinks.read_graph(spark, target)
    assert back.nodes.count() == 8 and back.edges.count() == 7
    with pytest.raises(Exception):
        sinks.write_graph(g, str(tmp_path), "v1")
    sinks.write_graph(g, str(tmp_path), "v1", "overwrite")
    sinks.write_graph_json(g, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/stats")).first()["n_edges"] == 7


def test_stored_form(spark):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": "v", "n": None}, datetime(2024, 1, 1))], "id string, sources array<string>, p map<string,string>, at timestamp")
    assert tuple(sinks.storable(df).first()) == ("a", "x, y", '{"k":"v"}', "2024-01-01T00:00:00")
    assert sinks.to_store_model(toy_graph(spark)).edges.where("eid = 'rbi__INFLUENCES__gdp'").first()["confidence"] == 0.8


def test_resume_and_checkpoint(spark, tmp_path):
    df = spark.range(10)
    sinks.write_checkpoint(df.where("id < 4"), str(tmp_path), "4")
    assert sinks.resume(df, spark.read.parquet(str(tmp_path)), "id").count() == 6


def test_cached_source():
    now, calls = [0.0], []

    def load():
        calls.append(1)
        if len(calls) > 1:
            raise OSError
        return "fresh"

    c = readers.CachedSource(load, "stub", 300, lambda: now[0])
    assert [c.get(), c.get()] == ["fresh", "fresh"] and len(calls) == 1
    now[0] = 400
    assert c.get() == "fresh" and len(calls) == 2
    assert readers.CachedSource(lambda: 1 / 0, "stub").get() == "stub"


def test_first_available(spark):
    def broken():
        raise OSError

    assert readers.first_available(broken, lambda: spark.range(0), lambda: spark.range(3)).count() == 3


def test_weights(tmp_path):
    f = tmp_path / "w.yaml"
    f.write_text("entity: 0.5\nunknown: 3\n")
    assert readers.load_weights(str(f))["entity"] == 0.5 and "unknown" not in readers.load_weights(str(f))
    assert readers.load_weights(str(tmp_path / "none"))["entity"] == 0.35


def test_corpus_files_and_split(spark, tmp_path):
    (tmp_path / "a_data.txt").write_text("short\nlong enough a line\n")
    assert [r["text"] for r in readers.read_corpus(spark, str(tmp_path / "*_data.txt")).collect()] == ["long enough a line"]
    parts = corpus.split(spark.range(2000), "id")
    n = parts.where("split = 'validation'").count()
    assert 50 < n < 150 and n == corpus.split(spark.range(2000).repartition(7), "id").where("split = 'validation'").count()


def test_beam_step(spark):
    beams = spark.createDataFrame([(0, -1.0, [-0.1, -2.0]), (1, -1.5, [-0.2, -0.3])], "beam int, score double, logp array<double>")
    assert [(r["parent"], r["token"], round(r["score"], 2)) for r in corpus.beam_step(beams, 2, 2).collect()] == [(0, 0, -1.1), (1, 0, -1.7)]


def test_providers(spark):
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x * 2

    assert with_retry(flaky, sleep=lambda s: None)(2) == 4 and len(tries) == 3
    assert chain(lambda t: None, lambda t: 1 / 0, str.upper)("a") == "A" and chain()("a") == "a"
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r["x"] for r in df.select(translated(F.col("t"), lambda t: t + "!").alias("x")).collect()] == ["a!", None]

    def extract(texts):
        return [[{"subject": t, "subject_type": "Company", "predicate": "is", "object": "B", "object_type": "Person", "confidence": 0.5, "sentiment": 0.0, "temporal": None, "source_text": t, "properties": None}] for t in texts]

    out = extracted(spark.createDataFrame([("A",), ("C",)], "section string"), extract)
    assert {r["subject"] for r in out.collect()} == {"A", "C"}


def test_memory_expires():
    now = [0.0]
    m = SessionMemory(clock=lambda: now[0])
    for i in range(12):
        m.add("s", "q", "a", [f"e{i}", "same"], [], ["ev"] if i == 11 else [])
    assert m.context("s")["entities"] == ["e11", "same", "e10", "e9", "e8", "e7"] and m.context("s")["event"] == "ev"
    assert len(m.turns["s"]) == 10
    now[0] = 4000
    assert m.context("s")["entities"] == []
    m.clear("s")


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"s{i % 2}", i, [f"e{i}", f"f{i % 3}"], start + timedelta(minutes=i)) for i in range(14)]
    df = spark.createDataFrame(rows, "session_id string, seq long, entities array<string>, at timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = stream_contexts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ctx").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["seq"]): r["context"] for r in spark.table("ctx").collect()}
    want = {(r["session_id"], r["seq"]): r["context"] for r in contexts(df).collect()}
    assert got == want


def fact(s, o, pred="deals with"):
    return (s, "Company", pred, o, "Company", 0.9, 0.1, None, "t", None)


def test_builder(spark, tmp_path):
    b = GraphBuilder(spark)
    b.add(spark.createDataFrame([fact("Zentara Mills", "Other House")], schema.FACTS))
    g = b.add(spark.createDataFrame([fact("Zentara Mills Ltd", "Third Place"), fact("Zentara Mills", "Other House")], schema.FACTS))
    assert g.nodes.count() == 3 and g.edges.count() == 2
    with pytest.raises(ValueError):
        GraphBuilder(spark, eps=0.5)
    spark.createDataFrame([fact("Fourth Thing", "Other House")], schema.FACTS).write.json(str(tmp_path / "f"))
    q = b.attach(spark.readStream.schema(spark.createDataFrame([], schema.FACTS).schema).json(str(tmp_path / "f")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert b.batches == 3 and b.graph.nodes.count() == 4


def at(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


def test_orphans_live_cycle(spark):
    edges = spark.createDataFrame([(1, "a", " B ", at(5)), (2, "ghost", None, at(5)), (3, "", "b", at(50))], "edge_no long, source string, target string, created_at timestamp")
    none = spark.createDataFrame([], "id string, deleted timestamp")
    t = OrphanTracker(spark)
    t.advance(references(edges), parents(spark.createDataFrame([("A", at(0))], "id string, created_at timestamp")), none)
    assert {tuple(r)[:3] for r in t.found().collect()} == {(1, "target", "missing"), (2, "source", "missing"), (3, "target", "missing")}
    t.advance(references(edges.limit(0)), parents(spark.createDataFrame([("b", at(9)), ("b", at(10))], "id string, created_at timestamp")), none)
    state = {(r["ref_no"], r["side"]): (r["why"], r["resolved"]) for r in t.state.read("orphans").collect()}
    assert state == {(1, "target"): ("late", True), (2, "source"): ("missing", False), (3, "target"): ("late", True)}
    gone = deletions(spark.createDataFrame([("A", at(60)), ("b", at(61))], "id string, deleted_at timestamp"))
    t.advance(references(edges.limit(0)), parents(spark.createDataFrame([], "id string, created_at timestamp")), gone)
    state = {(r["ref_no"], r["side"]): (r["why"], r["resolved"]) for r in t.state.read("orphans").collect()}
    assert state[1, "source"] == ("dangling", False) and state[1, "target"] == ("late", False)
    assert sum(r["open"] for r in t.snapshot().collect()) == 4


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Half the files, a new driver's builder and tracker at the same path, the rest: the same as all at once. A replay changes nothing."""
    from graphloom.streaming.incremental import attach_orphans

    facts = [[fact("Zentara Mills", "Other House")], [fact("Zentara Mills Ltd", "Third Place")], [fact("Fourth Thing", "Other House")]]
    whole = GraphBuilder(spark)
    for f in facts:
        whole.add(spark.createDataFrame(f, schema.FACTS))
    shape = spark.createDataFrame([], schema.FACTS).schema
    for i, f in enumerate(facts):
        spark.createDataFrame(f, schema.FACTS).coalesce(1).write.mode("append").json(str(tmp_path / "f"))
        b = GraphBuilder(spark, path=str(tmp_path / "graph"))
        b.attach(spark.readStream.schema(shape).json(str(tmp_path / "f")), str(tmp_path / "cp")).awaitTermination(120)
        assert b.batches == i + 1
    rows = lambda g: ({tuple(r) for r in g.nodes.collect()}, {tuple(r) for r in g.edges.collect()})
    assert rows(b.graph) == rows(whole.graph)
    b.add(spark.createDataFrame(facts[0], schema.FACTS), batch=2)
    assert b.batches == 3 and rows(b.graph) == rows(whole.graph)

    edge = "edge_no long, source string, target string, created_at timestamp"
    ents = spark.createDataFrame([("a", at(1)), ("b", at(9))], "id string, created_at timestamp")
    gone = spark.createDataFrame([("a", at(60))], "id string, deleted_at timestamp")
    for rows_in in ([(1, "a", "b", at(5))], [(2, "a", "ghost", at(70))]):
        spark.createDataFrame(rows_in, edge).coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
        t = OrphanTracker(spark, path=str(tmp_path / "orphans"))
        attach_orphans(t, spark.readStream.schema(edge).parquet(str(tmp_path / "x")), ents, gone, str(tmp_path / "c2")).awaitTermination(120)
    assert {tuple(r)[:3] for r in OrphanTracker(spark, path=str(tmp_path / "orphans")).found().collect()} == {(1, "target", "late"), (2, "source", "deleted"), (2, "target", "missing")}
    # a batch that fails leaves the version before it
    with pytest.raises(Exception, match="no_such_column"):
        t.advance(spark.range(1).select("no_such_column"), ents, gone)
    assert t.state.version == 1 and t.found().count() == 3


def test_orphans_empty_and_clashing(spark):
    edges = spark.createDataFrame([], "edge_no long, source string, target string, created_at timestamp, id string, why string")
    ents = spark.createDataFrame([], "id string, created_at timestamp, why string")
    gone = spark.createDataFrame([], "id string, deleted_at timestamp")
    assert track(edges, ents, gone).found().count() == 0
    edges = spark.createDataFrame([(1, "x", "y", at(1), "id", "w"), (1, "x", "y", at(1), "id", "w"), (2, "x", "y", None, None, None)], edges.schema)
    assert track(edges, ents, gone, keep_references=True).found().count() == 4


def test_profiles(spark):
    from graphloom.operators import profiles

    rows = spark.createDataFrame([("u1", "A", None), ("u2", "B", "Odd")], "id string, name string, investor_type string")
    full = profiles.with_defaults(rows)
    assert full.where("id = 'u1'").first()["investor_type"] == "Retail" and full.first()["risk_appetite"] == "Medium"
    assert [(r["id"], r["check"]) for r in profiles.violations(full).collect()] == [("u2", "investor_type")]
    assert profiles.maybe_one(profiles.visible_to(full, "u1"))["name"] == "A" and profiles.maybe_one(profiles.visible_to(full, "nobody")) is None
    with pytest.raises(ValueError):
        profiles.maybe_one(full)
    changed = profiles.update(full, "u2", investor_type="Student")
    assert profiles.violations(changed).count() == 0 and profiles.columns(changed)[0] == ("id", "string")


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    f = tmp_path / "g.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "name": "Zentara Mills", "label": "Company"}, {"id": "b", "name": "Zentara Mills Ltd", "label": "Company"}, {"id": "c", "name": "Carl", "label": "Person"}], "edges": [{"source": "a", "target": "c", "type": "led by"}, {"source": "b", "target": "c", "type": "led by"}]}))
    main(["clean", str(f), "--dry-run"])
    main(["clean", str(f), "--out", str(tmp_path), "--version", "clean"])
    main(["merge", str(tmp_path / "clean"), "--out", str(tmp_path), "--version", "merged"])
    main(["stats", str(tmp_path / "merged")])
    assert sinks.read_graph(spark, str(tmp_path / "merged")).nodes.count() == 2
    main(["ask", str(tmp_path / "merged"), "Who is Carl?"])
    assert "Zentara" in capsys.readouterr().out


def test_sentences(spark):
    r = spark.range(1).select(
        readers.macro_sentence(F.lit(2023), F.lit(7.2), F.lit(5.0), F.lit(60000.5), F.lit(82.1)).alias("macro"),
        readers.asian_sentence(F.lit(3), F.lit(1.5), F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("asian"),
        readers.price_sentence(F.lit("A"), F.lit("AA"), F.lit("1.0"), F.lit("5"), F.lit("2024-01-01")).alias("price"),
    ).first()
    assert r["macro"] == "As of 2023-01-01, India's GDP growth was 7.20%, inflation was 5.00%, the SENSEX closed at 60000.50, and the USD/INR exchange rate was 82.10."
    assert r["asian"].startswith("At observation 3: SENSEX=1.5, Straits Times Index=N/A, KOSPI=2.0") and r["asian"].endswith("across markets.")
    assert r["price"] == "A (NSE: AA) traded at a closing price of ₹1.0 with volume 5 on 2024-01-01."


def test_small_readers(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"question": "q", "gold_answer": "a"}\n\n{"gold_answer": "a"}\n')
    assert readers.read_benchmark(spark, str(tmp_path / "b.jsonl")).count() == 1
    (tmp_path / "m.csv").write_text("Company Name,Symbol,ISIN Code,Industry\nA,B,,Steel\n")
    m = readers.read_metadata(spark, str(tmp_path / "m.csv"))
    said = m.select(readers.metadata_sentence(F.col("Company Name"), F.col("Symbol"), F.col("ISIN Code"), F.col("Industry")).alias("s")).first()["s"]
    assert said == "A (Symbol: B, ISIN: N/A) is listed on NSE/BSE in the Steel industry."
    facts = spark.createDataFrame([fact("A", "B")], schema.FACTS)
    facts.write.json(str(tmp_path / "facts"))
    assert readers.extracted_facts(spark, str(tmp_path / "facts")).first()["subject"] == "A"
    pairs = corpus.split(spark.createDataFrame([(1, "s", "t"), (2, "u", "v")], "id long, src string, tgt string"), "id")
    sinks.write_split(pairs, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 2


def test_training_rows_and_pieces(spark):
    df = spark.createDataFrame([(list(range(600)), list(range(600)))], "src_ids array<int>, tgt_ids array<int>")
    r = corpus.training_rows(df).first()
    assert len(r["src_ids"]) == 512 and len(r["tgt_ids"]) == 512 and r["tgt_ids"][0] == 2 and r["tgt_ids"][-1] == 3
    ids = spark.createDataFrame([("hello world",), (None,)], "t string").select(corpus.piece_ids(F.col("t"), "/opt/tokenizers/piece_bpe_32k.model").alias("i")).collect()
    assert len(ids[0]["i"]) >= 2 and ids[1]["i"] == []
    assert spark.range(1).select(corpus.final_score(F.lit(-4.0), F.lit(2)).alias("x")).first()["x"] == -2.0


def test_windowed_counts(spark, tmp_path):
    from graphloom.streaming.incremental import attach_orphans, windowed_counts

    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(minutes=20 * i), "a", 1.0) for i in range(12)], "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["n"] for r in spark.table("win").collect()} == {3}
    edges = spark.createDataFrame([(1, "a", "b", at(5))], "edge_no long, source string, target string, created_at timestamp")
    edges.write.parquet(str(tmp_path / "x"))
    t = OrphanTracker(spark)
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "x"))
    attach_orphans(t, stream, spark.createDataFrame([("a", at(1))], "id string, created_at timestamp"), spark.createDataFrame([], "id string, deleted_at timestamp"), str(tmp_path / "c2")).awaitTermination(120)
    assert [tuple(r)[:3] for r in t.found().collect()] == [(1, "target", "missing")]


def test_graph_extras(spark):
    from graphloom.operators import graph, merge, paths

    g = toy_graph(spark)
    both = paths.shared_ends(paths.simple_paths(g, ["infosys"], max_hops=1), paths.simple_paths(g, ["wipro"], max_hops=1))
    assert [tuple(r) for r in both.collect()] == [("it_sector", "IT Sector")]
    e = spark.createDataFrame([("a", "R", "b", 1, 0.8, "s1"), ("a", "R", "b", 2, 0.0, "s2"), ("a", "R", "c", 3, None, "s1")], "src string, rel string, dst string, seq int, sentiment double, source string")
    rows = {r["dst"]: r for r in merge.fold_sentiment(e, ["src", "rel", "dst"]).collect()}
    assert rows["b"]["sentiment"] == 0.4 and rows["b"]["sentiment_label"] == "positive" and rows["b"]["sources"] == ["s1", "s2"] and rows["c"]["sentiment"] is None
    assert graph.quintuples(g.edges).where("o = 'gdp'").first()["t_start"] == "2024-04-01"
    n = sinks.upsert_nodes(spark.createDataFrame([("a", "L", "x")], "id string, label string, name string"), spark.createDataFrame([("a", "L", None), ("b", "L", "y")], "id string, label string, name string"))
    assert {tuple(r) for r in n.select("id", "name").collect()} == {("a", "x"), ("b", "y")}
    assert sinks.upsert_edges(g.edges, g.edges.limit(2)).count() == 7
