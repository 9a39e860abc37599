"""Lookups, back-fill, workbooks, decoding and the like: nulls, empty tables, repeats and clashing columns; brute force where there is any."""

import itertools
import json
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numeric, text
from graphloom.operators import clean, corpus, graph, merge, paths, profiles, search, series
from graphloom.plans import evaluate
from graphloom.session import Cuts, shared_dir
from graphloom.sources import readers, sinks
from graphloom.state import Versions
from tests.toy import toy_graph


def workbook(path, rows):
    """A worksheet with numbers, shared and inline strings, and gaps."""
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = ""
        for j, v in enumerate(row):
            ref = f"{'ABCDEFG'[j]}{i}"
            if isinstance(v, str) and i % 2:
                shared.append(v)
                cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
            elif isinstance(v, str):
                cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
            elif v is not None:
                cells += f'<c r="{ref}"><v>{v}</v></c>'
        body.append(f'<row r="{i}">{cells}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(body)}</sheetData></worksheet>")


def test_workbooks_without_a_library(spark, tmp_path):
    workbook(tmp_path / "m.xlsx", [["Year", "SENSEX", "x"], [2000, 1.5, None], [2001, None, "a"], [None, 3, "b"], [2002, 4, "c"]])
    rows = readers.read_excel(spark, str(tmp_path / "m.xlsx"), ["Year", "SENSEX"])
    assert sorted(tuple(r) for r in rows.collect()) == [("2000", "1.5", None), ("2002", "4", "c")]
    assert [tuple(r) for r in readers.read_excel(spark, str(tmp_path / "m.xlsx")).collect()] == [("2002", "4", "c")]
    workbook(tmp_path / "i.xlsx", [["Date", "Close"], *[[f"2024-01-{d:02d}", d] for d in range(1, 26)]])
    assert sorted(r["Date"] for r in readers.index_rows(spark, str(tmp_path / "i.xlsx")).collect()) == ["2024-01-01", "2024-01-11", "2024-01-21"]
    workbook(tmp_path / "e.xlsx", [])
    assert readers.read_excel(spark, str(tmp_path / "e.xlsx")).count() == 0


def markov(seed):
    """A scorer by the last token, over five tokens of which 3 ends."""
    r = random.Random(seed)
    table = [[-r.random() * 3 for _ in range(5)] for _ in range(5)]
    return lambda source, prefixes: [table[p[-1]] for p in prefixes]


@pytest.mark.parametrize("seed", range(4))
def test_decoding_equals_enumeration(seed):
    score = markov(seed)
    total = lambda ids: sum(score([], [[a]])[0][b] for a, b in zip([2, *ids], ids))
    every = [list(p) + [3] for n in range(4) for p in itertools.product([0, 1, 2, 4], repeat=n)]
    best = max(every, key=lambda ids: total(ids) / len(ids))
    assert corpus.decode([], score, beams=400, limit=4, alpha=1.0) == best[:-1]
    greedy, at = [], 2
    for _ in range(6):
        at = max(range(5), key=lambda t: score([], [[at]])[0][t])
        if at == 3:
            break
        greedy.append(at)
    assert corpus.decode([], score, limit=6) == greedy


def test_decoding_rules(spark):
    same = lambda source, prefixes: [[-1.0, -0.5, -9.0, -2.0] for _ in prefixes]
    assert corpus.decode([], same, limit=4) == [1, 1, 1, 1]
    free = corpus.decode([], same, limit=6, no_repeat=2)
    grams = list(zip([2, *free], free))
    assert len(set(grams)) == len(grams)
    assert corpus.decode([], same, limit=3, penalty=5.0)[:2] == [1, 0]
    df = spark.createDataFrame([(1, [4], 0), (2, None, 0)], "id int, src_ids array<int>, score int")
    out = {r["id"]: r["out_ids"] for r in corpus.generated(df, "src_ids", lambda: same, limit=2).collect()}
    assert {k: None if v is None else list(v) for k, v in out.items()} == {1: [1, 1], 2: None}


def test_small_functions(spark):
    rows = spark.createDataFrame([(1, "A", None, '{"k": 5, "s": "x"}'), (2, None, True, "not json"), (3, "C", False, None)], "id int, name string, flag boolean, props string")
    full = {r["id"]: (r["name"], r["flag"]) for r in profiles.back_fill(rows, {"name": "none", "flag": False, "absent": 1}).collect()}
    assert full == {1: ("A", False), 2: ("none", True), 3: ("C", False)}
    read = [tuple(r) for r in rows.orderBy("id").select(*numeric.json_values(F.col("props"), {"k": -1, "s": "?", "f": 0.5, "b": True})).collect()]
    assert read == [(5, "x", 0.5, True), (-1, "?", 0.5, True), (-1, "?", 0.5, True)]
    names = spark.createDataFrame([(1, "Firm"), (1, "Firm"), (None, "x")], "id int, name string")
    assert [r["said"] for r in series.looked_up(rows, names, "id", "name", "said").orderBy("id").collect()] == ["Firm", None, "C"]
    dates = spark.createDataFrame([("2023-05-01",), ("01-06-2023",), ("unknown",), (None,), ("2024",), ("2025-01-01",)], "d string")
    assert {r["d"] for r in series.between_dates(dates, "d", "2023-05-01", "2024-01-01").collect()} == {"2023-05-01", "01-06-2023", "2024"}
    users = spark.createDataFrame([("u1", "A", "Student", "High", "hi")], "id string, name string, investor_type string, risk_appetite string, language string")
    after = profiles.inserted(users, spark.createDataFrame([("u1", "again", "x"), ("u2", "B", "y"), ("u2", "B", "y")], "id string, name string, extra string"))
    assert {(r["id"], r["name"], r["investor_type"]) for r in after.collect()} == {("u1", "A", "Student"), ("u2", "B", "Retail")} and after.count() == 2


def test_mappings_and_rewiring(spark):
    g = toy_graph(spark)
    m = spark.createDataFrame([(" infosys ", "IT sector"), ("Infosys", "IT Sector"), ("Wipro", "Nowhere"), (None, "IT Sector"), ("Nobody", "IT Sector")], "name string, group string")
    assert [r["eid"] for r in graph.mapping_edges(m, g.nodes).collect()] == ["infosys|OPERATES_IN|it_sector"]
    assert graph.mapping_edges(m.limit(0), g.nodes).count() == 0
    redirect = spark.createDataFrame([("infosys", "i"), ("infosys", "i"), ("absent", "x")], "id string, to string")
    assert merge.rewired_count(g.edges, redirect).first()["rewired"] == 4 and merge.rewired_count(g.edges, redirect.limit(0)).first()["rewired"] == 0
    assert {r["to_id"] for r in search.neighbours_of(g, "infosys").collect()} == {"salil_parekh", "it_sector", "sebi", "narayana_murthy"}
    assert search.neighbours_of(g, "nobody at all").count() == 0


WORDS = ["Zentara", "Zentaro", "Zenith", "Mills", "Mill", "Steel", "Steels", "Limited", "Ltd", "Paper", "Papers"]


@pytest.mark.parametrize("seed", range(2))
def test_joins_by_bigrams_lose_nothing(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{i:03d}", " ".join(r.sample(WORDS, r.randint(1, 3))), r.choice(["Company", "Person"]), 0.5) for i in range(90)]
    nodes = spark.createDataFrame(rows, "id string, name string, label string, confidence double")
    key = lambda df: {(x["label"], x["a"], x["b"]) for x in df.select("label", "a", "b").collect()}
    assert key(merge.similar_pairs(merge.alike_pairs(nodes, 0.88))) == key(merge.similar_pairs(merge.block_pairs(nodes)))
    late, early = rows[:40], rows[40:]
    stem = {x["name"]: x["s"] for x in nodes.select("name", text.strip_legal_suffixes(F.col("name")).alias("s")).distinct().collect()}
    noise = {x["name"] for x in nodes.where(text.is_build_noise(F.col("name"))).collect()}

    def alike(x, y):
        a, b = x[1].lower(), y[1].lower()
        return x[2] == y[2] and not {x[1], y[1]} & noise and (stem[x[1]] == stem[y[1]] and len(stem[x[1]]) >= 4 or SequenceMatcher(None, a, b).ratio() >= 0.85)

    want = {(x[0], y[0]) for x in late for y in late if x[0] < y[0] and alike(x, y)} | {(x[0], y[0]) for x in late for y in early if x[1].lower()[:4] == y[1].lower()[:4] and alike(x, y)}
    make = lambda part: spark.createDataFrame(part, nodes.schema)
    assert {tuple(x) for x in merge.incremental_matches(make(late), make(early)).collect()} == want


def test_folds_of_long_and_hot_keys(spark):
    r = random.Random(3)
    rows = [("hot", i, r.uniform(-1, 1)) for i in range(300)] + [("one", 1, 0.4), ("two", 1, 0.4), ("two", 2, 0.2), ("two", 3, None), ("none", 1, None)]
    got = {x["k"]: (x["sentiment"], x["n"]) for x in series.running_sentiment(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()}
    for k in ("hot", "one", "two"):
        xs = [v for key, _, v in rows if key == k and v is not None]
        s = xs[0]
        for x in xs[1:]:
            s = (s + x) / 2
        assert abs(got[k][0] - s) < 1e-12 and got[k][1] == len(xs)
    assert "none" not in got


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_ranks(spark, n):
    r = random.Random(n)
    xs = [r.randint(0, 40) for _ in range(n)]
    df = spark.createDataFrame([(x, 1) for x in xs] + [(None, 1)], "x int, v int")
    for q in (0.0, 0.5, 0.95):
        assert evaluate.exact_rank(df, "x", q).first()["value"] == (sorted(xs)[int(n * q)] if n else None)
    assert [x["rank"] for x in series.ranked(df.where("x is not null"), F.col("x")).orderBy("x", "rank").collect()] == list(range(1, n + 1))


def test_pages_of_a_hub(spark):
    """A hub with more edges than a page, and ends that only a late page reaches."""
    n = 300
    nodes = spark.createDataFrame([("hub", "Hub", "X"), ("far", "Far", "X")] + [(f"n{i:03d}", f"N{i}", "X") for i in range(n)], "id string, name string, label string")
    edges = spark.createDataFrame([(f"e{i:03d}", "hub", f"n{i:03d}", "R", None, None, None) for i in range(n)] + [("x1", "n299", "far", "S", None, None, None)], "eid string, src string, dst string, rel string, t_announce string, t_effective string, source string")
    g = graph.Graph(nodes, edges, stored=True)
    rows = lambda df: [(r["hops"], r["node_ids"]) for r in df.orderBy("hops", F.array_join("eids", ">")).collect()]
    for options in ({"top_k": 2}, {"top_k": 310}, {"ends": ["far"], "top_k": 3}, {"ends": ["n007"], "top_k": 3}):
        assert rows(paths.find_paths(g, ["hub"], **options)) == rows(paths.find_paths(g, ["hub"], progressive=False, **options))
    assert paths.find_paths(g, ["absent"]).count() == 0 and paths.find_paths(g, []).count() == 0


def test_layouts_and_uploads(spark, tmp_path):
    g = toy_graph(spark)
    sinks.write_batches(g.nodes, str(tmp_path / "n"), 1)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 8 and len(list((tmp_path / "n" / "label=Company").glob("*.parquet"))) == 2
    sinks.write_by_id(g, str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids" / "adjacency")).where("a = 'infosys'").count() == 4


def test_benchmark_run(spark):
    from graphloom.plans.engine import Engine

    g = toy_graph(spark)
    items = spark.createDataFrame([("Which sector does Infosys operate in?", "IT Sector", [("operates_in", "IT Sector")]), (None, "x", None), ("zzz", "none", None)], "question string, gold_answer string, gold_path array<struct<rel:string,obj:string>>")
    rows = evaluate.run(Engine(g), items)
    r = evaluate.report(rows).first()
    assert r["n"] == 2 and r["path_match"] == 1.0 and r["exact_match"] == 0.5 and r["p50"] > 0


def test_commands(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    f = tmp_path / "g.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "name": "Zentara Mills", "label": "Company"}, {"id": "c", "name": "Carl", "label": "Person"}], "edges": [{"source": "a", "target": "c", "type": "led by"}, {"source": "a", "target": "ghost", "type": "led by"}]}))
    main(["upload", str(f), "--out", str(tmp_path / "up")])
    assert "1" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "up" / "edges")).count() == 1
    facts = tmp_path / "facts.jsonl"
    facts.write_text(json.dumps({"subject": "Zentara Mills", "subject_type": "Company", "predicate": "led by", "object": "Carl Moe", "object_type": "Person", "confidence": 0.9}) + "\n")
    for _ in range(2):  # the batch comes twice
        main(["build", str(facts), "--state", str(tmp_path / "state"), "--batch", "0", "--out", str(tmp_path / "out"), "--version", f"v{_}"])
    assert Versions(spark, str(tmp_path / "state"), {"nodes": "id string", "edges": "eid string"}).version == 0
    assert sinks.read_graph(spark, str(tmp_path / "out" / "v1")).edges.count() == 1


def test_versions(spark, tmp_path):
    path, shape = str(tmp_path / "v"), {"t": "k string, n int"}
    v = Versions(spark, path, shape, buckets=4)
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    with v.update(5) as fresh:
        assert fresh
        v.append("t", df(("a", 1), ("b", 2)), "k", "n")
    with v.update(5) as fresh:
        assert not fresh
    with v.update():
        v.replace("t", df(("a", 9)), "k", v.touched(df(("a", 0)), "k"))
    again = Versions(spark, path, shape)
    assert (again.version, again.batch, again.buckets) == (1, 5, 4)
    assert {tuple(r) for r in again.read("t").collect()} >= {("a", 9)} and ("a", 1) not in {tuple(r) for r in again.read("t").collect()}
    with pytest.raises(ValueError), again.update(6):
        again.append("t", df(("c", 3)), "k")
        raise ValueError
    assert "c" not in {r["k"] for r in again.read("t").collect()} and again.version == 1
    again.clear()
    assert Versions(spark, path, shape).version == -1


def test_audit_counts(spark):
    g = graph.Graph(spark.createDataFrame([("a", "A Corp", "Company"), ("b", "B Corp", "Company"), ("c", "C", "Company"), ("a", "A again", "Company")], "id string, name string, label string"), spark.createDataFrame([("1", "a", "b", "led by"), ("2", "a", "b", "LED_BY"), ("3", "a", "a", "X"), ("4", "a", "ghost", "X"), ("5", None, "b", "X")], "eid string, src string, dst string, rel string"))
    r = clean.audit(g).first().asDict()
    assert {k: r[k] for k in ("renamed", "loops", "nodes_left", "edges_left", "orphans")} == {"renamed": 1, "loops": 1, "nodes_left": 3, "edges_left": 1, "orphans": 1}
    assert set(clean.audit(graph.Graph(g.nodes.limit(0), g.edges.limit(0))).first()) == {0}


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
    assert Cuts(spark, "x").base.startswith(shared_dir(spark))
