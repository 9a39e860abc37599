import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import numeric, temporal, text
from graphloom.plans import evaluate, explain, questions
from graphloom.plans.engine import Engine, SmallGraph, rewritten
from graphloom.queries.text_queries import SAMPLES
from tests.toy import toy_graph


@pytest.fixture(scope="module")
def toy(spark):
    return toy_graph(spark)


@pytest.fixture(scope="module")
def engine(toy):
    return Engine(toy, SmallGraph(toy))


def test_ask(engine):
    a = engine.ask("Which sector does Infosys operate in?")
    assert a.plan.kind == "single_hop" and a.plan.relations == ["OPERATES_IN"]
    assert "Infosys" in a.entities and a.paths and a.steps
    assert "OPERATES_IN" in a.text or "operates in" in a.text


def test_follow_up_uses_the_session(engine):
    engine.ask("What about Wipro?", session="s")
    assert engine.ask("Which sector is it in?", session="s").plan.follow_up
    assert not engine.ask("Which sector is it in?", session="other").plan.follow_up


def test_no_entity(engine):
    a = engine.ask("zzz qqq", session="empty")
    assert a.text == explain.NO_PATH and a.warn
    assert engine.describe("zzz qqq").startswith("Sorry")
    assert "**Infosys** [Company]" in engine.describe("tell me about Infosys")


def by_hand(q):
    """Kind, relations and temporal words of a question, looked up one by one."""
    low = q.lower()
    rules = {"multi_hop_chain": vocab.CHAIN_PATTERNS, "multi_hop_intersection": vocab.INTERSECTION_PATTERNS, "temporal": vocab.TEMPORAL_PATTERNS}
    kind = next((k for k, ps in rules.items() if any(re.search(p, low) for p in ps)), "single_hop")
    rels = [r for k in sorted(vocab.PREDICATES, key=len, reverse=True) if k in low for r in vocab.PREDICATES[k]]
    word = max((w for w in vocab.TEMPORAL_WORDS if w in low), key=len, default=None)
    found = re.search(re.escape(word) + r"\s+([a-z0-9\s/,-]{3,30})", low) if word else None
    return kind, list(dict.fromkeys(rels)), vocab.TEMPORAL_WORDS.get(word), found.group(1).strip().rstrip(".,?") if found else None


@pytest.mark.parametrize("q", SAMPLES)
def test_columns_agree_with_rules_by_hand(spark, q):
    df = spark.createDataFrame([(q,)], "question string")
    r = df.select(text.classify_question(F.col("question")).alias("k"), text.link_relations(F.col("question")).alias("r"), text.temporal_operator(F.col("question")).alias("op"), text.temporal_reference(F.col("question")).alias("ref"), text.rewrite_synonyms(F.col("question")).alias("w"), text.spans(F.col("question")).alias("s")).first()
    assert (r["k"], r["r"], r["op"], r["ref"]) == by_hand(q)
    assert r["w"] == rewritten(q)
    assert r["s"] == questions.mentions(q)


@pytest.mark.parametrize("q", SAMPLES[:-1])
def test_sub_questions_agree(spark, q):
    rows = questions.sub_questions(spark.createDataFrame([(q,)], "question string")).orderBy("step").collect()
    plan = questions.plan_question(q)
    assert [r["part"] for r in rows] == [s.text for s in plan.steps]
    assert (plan.kind, plan.relations) == by_hand(q)[:2]


def test_plans_take_what_the_session_carries():
    one = questions.plan_question("Which sector does it operate in?", ["Infosys", "Wipro"])
    assert (one.question, one.follow_up, one.steps[0].anchor, one.steps[0].relation) == ("Which sector does Infosys operate in?", True, "Infosys", "OPERATES_IN")
    chain = questions.plan_question("as a result of the rate cut which banks were hit due to rules that benefited by delay", ["A", "B"])
    assert chain.kind == "multi_hop_chain" and [s.anchor for s in chain.steps] == ["A", "B", *[None] * (len(chain.steps) - 2)] and len(chain.steps) > 2


def test_models_are_asked_first(toy):
    from graphloom.providers import Models

    said = Models(decompose=lambda q: ["Infosys sector", "Wipro sector"], synthesise=lambda q, lines: f"told by {len(lines)}", explain=lambda q, lines: ["Step 1: Infosys operates in IT Sector.", "no step", "Step 2: made up."], verify=lambda s, lines: "made up" not in s)
    a = Engine(toy, SmallGraph(toy), models=said).ask("Which sector does Infosys operate in?")
    assert [s.text for s in a.plan.steps] == ["Infosys sector", "Wipro sector"] and a.text.startswith("told by ") and a.steps == ["Step 1: Infosys operates in IT Sector."]

    def broken(*_):
        raise RuntimeError

    b = Engine(toy, SmallGraph(toy), models=Models(broken, broken, broken, broken)).ask("Which sector does Infosys operate in?")
    assert "Infosys" in b.text and b.steps and len(b.plan.steps) == 1


def test_calls_at_once_and_embeddings(spark):
    import threading

    from graphloom.providers import embedded, gather

    lock, now, most = threading.Lock(), [0], [0]

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        if x == 3:
            raise ValueError
        return x * 2

    assert gather(call, range(8), at_once=3, sleep=lambda _: None) == [0, 2, 4, None, 8, 10, 12, 14] and 1 < most[0] <= 3
    df = spark.createDataFrame([("Infosys profit",), ("infosys profit",), (None,), ("",)], "t string").select(embedded(F.col("t")).alias("v"))
    a, b, c, d = [r["v"] for r in df.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and c is None and len(d) == 64


def test_last_connector_keeps_its_word(spark):
    q = "which banks were hit due to rules that benefited by delay"
    parts = spark.range(1).select(questions.split_chain(F.lit(q)).alias("p")).first()["p"]
    assert parts == ["which banks were hit", "rules", "benefited", "delay"]


def test_pronouns_with_regex_characters(spark):
    r = spark.range(1).select(text.resolve_pronouns(F.lit("What did they say about the event?"), F.lit(r"A$1\B"), F.lit("IPO")).alias("x")).first()["x"]
    assert r == r"What did A$1\B say about IPO?"


@pytest.mark.parametrize(("word", "lang"), [("hello", "en"), ("नमस्ते दुनिया", "hi"), ("வணக்கம்", "ta"), ("నమస్తే", "te"), ("ನಮಸ್ಕಾರ", "kn"), ("നമസ്കാരം", "ml"), ("this is mostly English आज", "mixed"), ("", "en"), ("123", "en")])
def test_scripts(spark, word, lang):
    assert spark.range(1).select(text.detect_script(F.lit(word)).alias("x")).first()["x"] == lang


def test_transliteration(spark):
    assert spark.range(1).select(text.transliterate(F.lit("नमक ok")).alias("x")).first()["x"] == "nmk ok"
    assert len(vocab.DEVANAGARI_LATIN) == 53


@pytest.mark.parametrize(("name", "noise"), [("buy", True), ("abc", True), ("rs.", True), ("TCS", False), ("NSE", False), ("RBI", False), ("", True), (None, True), ("12.5%", True), ("Infosys", False)])
def test_build_noise(spark, name, noise):
    assert spark.range(1).select(text.is_build_noise(F.lit(name).cast("string")).alias("x")).first()["x"] is noise


DATES = [
    ("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T10:11:12", "2024-03-05 10:11:12"), ("2024-03-05 10:11", "2024-03-05 10:11:00"), ("05-03-2024", "2024-03-05 00:00:00"), ("05/03/2024", "2024-03-05 00:00:00"),
    ("2024", "2024-01-01 00:00:00"), ("2024-07", "2024-07-01 00:00:00"), ("2024-04-01 to 2025-03-31", "2024-04-01 00:00:00"), ("2024-04-01/2024-06-30", "2024-04-01 00:00:00"), ("before 2024-04-01", "2024-04-01 00:00:00"),
    ("unknown", None), ("N/A", None), ("YYYY-MM-DD", None), ("near term", None), ("FY25-27", None), ("", None), (None, None), ("2024-13", None),
]


@pytest.mark.parametrize(("raw", "want"), DATES)
def test_dates(spark, raw, want):
    x = temporal.tolerant_timestamp(F.lit(raw).cast("string"))
    assert spark.range(1).select(F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias("x")).first()["x"] == want


def test_answers_and_grounding(spark):
    t = "struct<subj:string,rel:string,obj:string,time:string,source:string>"
    rows = [([("A Corp", "CEO_OF", "Bea", "2020", "s1")], ["Bea"], "single_hop"), ([], ["Bea"], "single_hop"), ([], [], "single_hop"), (None, [], "single_hop"), ([("A Corp", "X_Y", "Bea", None, None), ("Bea", "Z", "Cee", None, None)], [], "multi_hop_chain")]
    df = spark.createDataFrame(rows, f"triples array<{t}>, candidates array<string>, kind string")
    said = [r["a"] for r in df.select(explain.answer(F.col("triples"), F.col("candidates"), F.col("kind")).alias("a")).collect()]
    assert said[0] == "**A Corp** is the CEO of **Bea** (as of 2020)."
    assert said[1] == "Based on the KG, the answer is: **Bea**." and said[2] == explain.NO_ANSWER and said[3] == explain.NO_PATH
    assert said[4] == "Following the reasoning chain:\nA Corp -[X_Y]-> Bea  ->  Bea -[Z]-> Cee\n\n**Answer: Cee**"
    v = explain.verify(explain.steps(df.where("triples is not null"))).collect()
    assert all(r["alignment"] == 1.0 and r["passed"] for r in v)


def test_report(spark):
    rows = [("x", " X ", [("led_by", "B")], 1.0, 10.0), ("x", "y", None, 0.0, 20.0), ("x", "y", [("other", "B")], 0.5, 30.0)]
    df = spark.createDataFrame(rows, "gold_answer string, answer string, gold_path array<struct<rel:string,obj:string>>, faithful double, latency double")
    r = evaluate.report(df.withColumn("triples", F.array(F.struct(F.lit("LED_BY").alias("rel"), F.lit("b").alias("obj"))))).first()
    assert (r["n"], round(r["exact_match"], 3), r["path_match"], r["faithfulness"], r["p50"], r["p95"]) == (3, 0.333, 0.5, 0.5, 20.0, 30.0)


def test_token_functions(spark):
    r = spark.range(1).select(
        numeric.blocked_tokens(F.array(*map(F.lit, [1, 2, 3, 1, 2])), 3).alias("b"), numeric.top_k_indices(F.array(*map(F.lit, [0.1, 0.9, 0.9])), 2).alias("t"), numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"),
        numeric.has_repeated_ngram(F.array(F.lit(1)), 2).alias("r"),
    ).first()
    assert r["b"] == [3] and r["t"] == [1, 2] and r["c"] is None and r["r"] is False


def test_suffix_pass_order(spark):
    r = spark.range(1).select(text.strip_legal_suffixes(F.lit("  Acme   Pvt Ltd. ")).alias("a"), text.strip_legal_suffixes(F.lit("Acme Ltd Private")).alias("b")).first()
    assert r["a"] == "acme" and r["b"] == "acme ltd"


def test_report_of_nothing(spark):
    t = "array<struct<rel:string,obj:string>>"
    r = evaluate.report(spark.createDataFrame([], f"gold_answer string, answer string, gold_path {t}, triples {t}, faithful double, latency double")).first()
    assert r["n"] == 0 and r["p50"] is None and r["exact_match"] is None
