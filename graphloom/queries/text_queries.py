"""Queries on text functions, question planning and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import text
from graphloom.operators import corpus
from graphloom.plans import evaluate, explain, questions
from graphloom.queries.registry import query
from graphloom.session import table
from graphloom.sources import readers


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("""SELECT doc_id, '[' || coalesce(strftime(published_at, '%Y-%m-%d'), '') || '] ' || coalesce(title, '') || chr(10) || text[:1200] AS section FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300 OFFSET 50) WHERE trim(coalesce(text, '')) <> ''""")
def s1_news_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    return readers.news_sections(docs, "doc_id", skip=50, limit=300, title="title", content="text", date="day").select(F.col("seq").alias("doc_id"), "section")


@query("""SELECT doc_id, n::BIGINT AS n FROM (SELECT doc_id, title, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 15)) WHERE trim(coalesce(title, '')) NOT IN ('', '[Removed]')""")
def s14_headlines(spark: SparkSession, d: str) -> DataFrame:
    return readers.headlines(_docs(spark, d), "doc_id").select("doc_id", F.col("n").cast("long").alias("n"))


@query("SELECT doc_id, 'IFN_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def s10_synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.with_ids(_docs(spark, d).select("doc_id"), "IFN", "doc_id").select("doc_id", "id")


@query("SELECT doc_id FROM documents WHERE published_at BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2024-06-30'")
def f5_date_range(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.col("published_at").between(F.lit("2023-01-01").cast("timestamp"), F.lit("2024-06-30").cast("timestamp"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(title, '')), 'dividend') OR contains(lower(coalesce(title, '')), 'tariff') OR contains(lower(coalesce(text, '')), 'dividend') OR contains(lower(coalesce(text, '')), 'tariff')")
def f6_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(text.any_keyword([F.col("title"), F.col("text")], ["Dividend", "tariff"])).select("doc_id")


@query(r"SELECT pair_id FROM parallel_pairs WHERE length(trim(src)) > 20 AND length(trim(tgt)) > 20 AND regexp_matches(tgt, '[^\x00-\x7F]')")
def f15_usable_pairs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.usable_pairs(table(spark, d, "parallel_pairs")).select("pair_id")


USABLE = r"(SELECT * FROM parallel_pairs WHERE length(trim(src)) > 20 AND length(trim(tgt)) > 20 AND regexp_matches(tgt, '[^\x00-\x7F]'))"


def _bare(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


@query(f"SELECT pair_id, {_bare('src')} AS src, {_bare('tgt')} AS tgt, 'en→' || lang AS direction FROM {USABLE} UNION ALL SELECT pair_id, {_bare('tgt')}, {_bare('src')}, lang || '→en' FROM {USABLE}")
def u3_both_directions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.both_directions(corpus.usable_pairs(table(spark, d, "parallel_pairs"))).select("pair_id", "src", "tgt", "direction")


@query("SELECT pair_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pair_id) AS rn FROM parallel_pairs) WHERE rn <= 40")
def w15_cap_per_language(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cap_per_language(table(spark, d, "parallel_pairs"), 40, "pair_id").select("pair_id", "lang")


@query("SELECT CASE WHEN ('0x' || substr(md5(pair_id::VARCHAR), 1, 8))::BIGINT % 100 < 5 THEN 'validation' ELSE 'train' END AS split, count(*)::BIGINT AS n FROM parallel_pairs GROUP BY 1")
def w14_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split(table(spark, d, "parallel_pairs"), "pair_id").groupBy("split").agg(F.count("*").alias("n"))


TEXTS = "(SELECT request_id, message FROM chat_requests WHERE message IS NOT NULL)"


def _chats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_requests").where("message is not null").select("request_id", "message")


@query(f"""WITH c AS (SELECT request_id, message, {', '.join(f"len(regexp_extract_all(message, '[{r}]')) AS {k}" for k, r in vocab.SCRIPT_RANGES)}, len(regexp_extract_all(message, '[a-zA-Z]')) AS latin FROM {TEXTS})
SELECT request_id, CASE WHEN ta + te + kn + ml + hi = 0 THEN 'en' WHEN (ta + te + kn + ml + hi) / (ta + te + kn + ml + hi + latin) < 0.4 THEN 'mixed' WHEN ta = m THEN 'ta' WHEN te = m THEN 'te' WHEN kn = m THEN 'kn' WHEN ml = m THEN 'ml' ELSE 'hi' END AS script
FROM (SELECT *, greatest(ta, te, kn, ml, hi) AS m FROM c)""")
def t14_detect_script(spark: SparkSession, d: str) -> DataFrame:
    return _chats(spark, d).select("request_id", text.detect_script(F.col("message")).alias("script"))


@query(rf"""SELECT request_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(message), '\p{{C}}', '', 'g'), '`', ''''), '[–—]', '-', 'g'), '\s+', ' ', 'g')) AS normal FROM {TEXTS}""")
def t15_normalise_english(spark: SparkSession, d: str) -> DataFrame:
    return _chats(spark, d).select("request_id", text.normalise_english(F.col("message")).alias("normal"))


@query("SELECT request_id, " + reduce(lambda s, kv: f"replace({s}, '{kv[0]}', '{kv[1]}')", vocab.DEVANAGARI_LATIN.items(), "message") + f" AS latin FROM {TEXTS}")
def t16_transliterate(spark: SparkSession, d: str) -> DataFrame:
    return _chats(spark, d).select("request_id", text.transliterate(F.col("message")).alias("latin"))


ITEMS = "(SELECT item_id, question FROM eval_items WHERE question IS NOT NULL)"
SAMPLES = [
    "What did Infosys report?", "How did RBI rate cut impact IT sector?", "What about Wipro?", "Infosys ne kya announce kiya?", "Which sector does Infosys operate in?", "What is the impact of crude oil on inflation?",
    "Which companies benefited from the merger after June 2023?", "connection between Infosys and Wipro", "What happened after the trade war?", "both TCS and Wipro", "how does inflation affect gold prices?", "Show me results for FY 2024",
    "Who is the CEO of L&T?", "US taxes and Indian markets", "what changed because of interest rates due to the rate cut", "",
]
ASKED = f"(SELECT item_id, question FROM {ITEMS} UNION ALL SELECT 100000 + i, q FROM (SELECT unnest(range({len(SAMPLES)})) AS i, unnest({_list(SAMPLES)}) AS q))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stored questions and a few of each type, which the stored ones lack."""
    items = table(spark, d, "eval_items").where("question is not null").select("item_id", "question")
    own = spark.createDataFrame([(100000 + i, q) for i, q in enumerate(SAMPLES)], "item_id long, question string")
    return items.unionByName(own)


def _any(patterns) -> str:
    return " OR ".join(f"regexp_matches(lower(question), {_q(p)})" for p in patterns)


@query(f"SELECT item_id, CASE WHEN {_any(vocab.CHAIN_PATTERNS)} THEN 'multi_hop_chain' WHEN {_any(vocab.INTERSECTION_PATTERNS)} THEN 'multi_hop_intersection' WHEN {_any(vocab.TEMPORAL_PATTERNS)} THEN 'temporal' ELSE 'single_hop' END AS kind FROM {ASKED}")
def t10_classify(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", text.classify_question(F.col("question")).alias("kind"))


ORDERED = sorted(vocab.PREDICATES.items(), key=lambda kv: -len(kv[0]))
PREDICATE_ROWS = ", ".join(f"({i * 10 + j}, {_q(k)}, {_q(r)})" for i, (k, v) in enumerate(ORDERED) for j, r in enumerate(v))


@query(f"""WITH p(rank, k, r) AS (VALUES {PREDICATE_ROWS}), m AS (SELECT item_id, r, min(rank) AS rank FROM {ASKED}, p WHERE contains(lower(question), k) GROUP BY item_id, r)
SELECT a.item_id, coalesce(string_agg(r, ',' ORDER BY rank), '') AS relations FROM {ASKED} a LEFT JOIN m USING (item_id) GROUP BY a.item_id""")
def t7_link_relations(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", F.array_join(text.link_relations(F.col("question")), ",").alias("relations"))


WORDS = sorted(vocab.TEMPORAL_WORDS.items(), key=lambda kv: -len(kv[0]))
OP = "CASE " + " ".join(f"WHEN contains(lower(question), {_q(w)}) THEN {_q(op)}" for w, op in WORDS) + " END"
REF = "CASE " + " ".join(rf"WHEN contains(lower(question), {_q(w)}) THEN nullif(regexp_replace(trim(regexp_replace(regexp_extract(lower(question), '{w}\s+([a-z0-9\s/,-]{{3,30}})', 1), '^\s+|\s+$', '', 'g')), '[.,?]+$', ''), '')" for w, _ in WORDS) + " END"


@query(f"SELECT item_id, {OP} AS op, {REF} AS ref FROM {ASKED}")
def t8_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", text.temporal_operator(F.col("question")).alias("op"), text.temporal_reference(F.col("question")).alias("ref"))


SYNONYM_SQL = "question"
for _p, _v in vocab.SYNONYMS:
    SYNONYM_SQL = f"regexp_replace({SYNONYM_SQL}, {_q('(?i)' + _p)}, {_q(_v)}, 'g')"


@query(f"SELECT item_id, {SYNONYM_SQL} AS rewritten FROM {ASKED}")
def t9_rewrite_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", text.rewrite_synonyms(F.col("question")).alias("rewritten"))


BETWEEN = "CASE " + " ".join(f"WHEN regexp_matches(trim(question), {_q(p)}) THEN trim(regexp_extract(trim(question), {_q(p)}, 1)) || ' / ' || trim(regexp_extract(trim(question), {_q(p)}, 2))" for p in vocab.BETWEEN_PATTERNS) + " END"


@query(f"SELECT item_id, {BETWEEN} AS pair FROM {ASKED}")
def t11_between(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", F.array_join(text.between_entities(F.col("question")), " / ").alias("pair"))


@query()
def t12_sub_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions.sub_questions(_asked(spark, d)).select("item_id", "kind", "step", "part", "anchor", "target")


@query(f"""WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(question), '\\s+'), lambda x: x <> '') AS ws FROM {ASKED}),
s AS (SELECT item_id, size, i, ws[i:i + size - 1] AS run FROM w, (SELECT unnest([1, 2, 3, 4]) AS size), (SELECT unnest(range(1, 400)) AS i) WHERE i + size - 1 <= len(ws)),
c AS (SELECT item_id, size, i, regexp_replace(lower(array_to_string(run, ' ')), '^[?.,!]+|[?.,!]+$', '', 'g') AS span FROM s WHERE len(list_filter(run, lambda x: NOT list_contains({_list(vocab.STOPWORDS)}, lower(x)))) > 0),
f AS (SELECT item_id, span, min(struct_pack(a := -size, b := i)) AS first FROM c GROUP BY item_id, span)
SELECT item_id, string_agg(span, '|' ORDER BY first) AS spans FROM f GROUP BY item_id""")
def t6_spans(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", F.array_join(text.spans(F.col("question")), "|").alias("spans")).where("spans <> ''")


ALIAS_ROWS = ", ".join(f"({i}, {_q(k)}, {_q(','.join(v))})" for i, (k, v) in enumerate(vocab.ALIASES.items()))


@query(f"""WITH a(rank, k, names) AS (VALUES {ALIAS_ROWS}) SELECT item_id, arg_min(names, rank) AS names FROM {ASKED}, a WHERE contains(' ' || trim(lower(question)) || ' ', ' ' || k || ' ') GROUP BY item_id""")
def t5_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", F.array_join(text.aliases(F.col("question")), ",").alias("names")).where("names <> ''")


@query(f"""SELECT request_id, regexp_replace(message, '(?i)\\b(they|their|them|it|its|the company|this company|that company)\\b', 'R$1 & Sons', 'g') AS resolved FROM {TEXTS}""")
def t13_pronouns(spark: SparkSession, d: str) -> DataFrame:
    # the name holds a dollar sign, which must not be taken for a group
    return _chats(spark, d).select("request_id", text.resolve_pronouns(F.col("message"), F.lit("R$1 & Sons"), F.lit(None).cast("string")).alias("resolved"))


@query("SELECT DISTINCT predicate, CASE WHEN s = '' THEN 'RELATED_TO' ELSE upper(s) END AS rel FROM (SELECT predicate, regexp_replace(regexp_replace(regexp_replace(predicate, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS s FROM relationships WHERE predicate IS NOT NULL)")
def t17_upper_snake(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships").where("predicate is not null").select("predicate").distinct().select("predicate", text.upper_snake(F.col("predicate")).alias("rel"))


@query("SELECT DISTINCT id, replace(replace(upper(name), ' ', '_'), '-', '_') AS key FROM entities WHERE name IS NOT NULL")
def t21_upper_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("id", text.upper_id(F.col("name")).alias("key")).distinct()


@query("SELECT p_partkey, p_name || ' (Symbol: ' || p_brand || ', ISIN: N/A) is listed on NSE/BSE in the ' || p_type || ' industry.' AS sentence FROM part")
def t22_sentences(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", readers.metadata_sentence(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")).alias("sentence"))


PHRASES = "CASE rel " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in vocab.STEP_PHRASES.items()) + " ELSE replace(lower(rel), '_', ' ') END"
TRIPLES = """(SELECT edge_no, coalesce(source, '?') AS subj, upper(regexp_replace(regexp_replace(regexp_replace(predicate, '^\\s+|\\s+$', '', 'g'), '[\\s\\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) AS rel, coalesce(target, '?') AS obj, strftime(temporal.t_announce, '%Y-%m-%d') AS time FROM relationships)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships")
    t = F.struct(F.coalesce("source", F.lit("?")).alias("subj"), text.upper_snake(F.col("predicate")).alias("rel"), F.coalesce("target", F.lit("?")).alias("obj"), F.date_format("temporal.t_announce", "yyyy-MM-dd").alias("time"), F.lit(None).cast("string").alias("source"))
    return r.select("edge_no", "name", t.alias("t"))


@query(f"SELECT edge_no, 'Step 1: **' || subj || '** ' || {PHRASES} || ' **' || obj || '**' || CASE WHEN coalesce(time, '') <> '' THEN ' (recorded: ' || time || ')' ELSE '' END || '.' AS said FROM {TRIPLES}")
def t23_steps(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("edge_no", explain.step_sentence(F.lit(1), F.col("t")).alias("said"))


ANSWERS = "CASE rel " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in vocab.ANSWER_PHRASES.items()) + " ELSE replace(lower(rel), '_', ' ') END"


@query(f"SELECT edge_no, '**' || subj || '** ' || {ANSWERS} || ' **' || obj || '**' || CASE WHEN coalesce(time, '') <> '' THEN ' (as of ' || time || ')' ELSE '' END || '.' AS said FROM {TRIPLES}")
def t24_answers(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("edge_no", explain.answer(F.array("t"), F.array().cast("array<string>"), F.lit("single_hop")).alias("said"))


@query(f"""SELECT edge_no, ((length(subj) > 2 AND contains(s, lower(subj)))::INT + (length(obj) > 2 AND contains(s, lower(obj)))::INT + (rel <> '' AND contains(s, replace(lower(rel), '_', ' ')))::INT) >= 2 AS grounded
FROM (SELECT *, lower(subj || ' and the rest: ' || replace(rel, '_', CASE WHEN edge_no % 2 = 0 THEN ' ' ELSE '-' END)) AS s FROM {TRIPLES})""")
def t25_grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = _triples(spark, d)
    s = F.concat(F.col("t.subj"), F.lit(" and the rest: "), F.replace(F.col("t.rel"), F.lit("_"), F.when(F.col("edge_no") % 2 == 0, F.lit(" ")).otherwise(F.lit("-"))))
    return rows.select("edge_no", explain.is_grounded(s, F.array("t")).alias("grounded"))


@query("SELECT edge_no, json_extract_string(custom, '$.area') AS area FROM relationships WHERE json_extract_string(custom, '$.area') IS NOT NULL")
def t26_parse_json(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("```json\n"), "custom", F.lit("\n```"))
    return table(spark, d, "relationships").select("edge_no", readers.parse_model_json(c, "area string")["area"].alias("area")).where("area is not null")


@query(f"SELECT edge_no, subj || ' -[' || rel || ']-> ' || obj || CASE WHEN coalesce(time, '') <> '' THEN ' (' || time || ')' ELSE '' END AS line FROM {TRIPLES}")
def t27_triple_lines(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("edge_no", explain.triple_line(F.col("t")).alias("line"))


@query("SELECT item_id, regexp_replace(trim(lower(question)), '\\s+', ' ', 'g') = regexp_replace(trim(lower(CASE WHEN item_id % 2 = 0 THEN ' ' || upper(question) ELSE gold_answer END)), '\\s+', ' ', 'g') AS same FROM eval_items WHERE question IS NOT NULL AND gold_answer IS NOT NULL")
def t28_same_answer(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").where("question is not null and gold_answer is not null")
    return e.select("item_id", text.same_answer(F.col("question"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), F.upper("question"))).otherwise(F.col("gold_answer"))).alias("same"))


@query("SELECT pair_id, trim(regexp_replace('<2' || lang || '> ' || src, '<2[a-z]{2}>', '', 'g')) AS src FROM parallel_pairs")
def t29_direction_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parallel_pairs").select("pair_id", text.strip_direction_tokens(F.concat(F.lit("<2"), "lang", F.lit("> "), "src")).alias("src"))


@query("SELECT DISTINCT id, CASE WHEN trim(coalesce(label, '')) = '' THEN name ELSE name || ' (' || trim(label) || ')' END AS shown FROM entities WHERE name IS NOT NULL")
def t30_display_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("id", text.display_name(F.col("name"), F.col("label")).alias("shown")).distinct()


@query("""SELECT item_id, len(list_filter(gold_path, lambda g: upper(g.rel) = 'LED_BY' AND lower(g.obj) = lower(gold_answer))) > 0 AS hit FROM eval_items WHERE gold_path IS NOT NULL AND len(gold_path) > 0""")
def j13_path_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").where("gold_path is not null and size(gold_path) > 0")
    found = F.array(F.struct(F.lit("led_by").alias("rel"), F.upper("gold_answer").alias("obj")))
    return e.select("item_id", evaluate.path_match(F.col("gold_path"), found).alias("hit"))


@query("""SELECT count(*)::BIGINT AS n, round(avg((item_id % 3 = 0)::INT), 4)::DOUBLE AS exact_match, round(avg(CASE WHEN len(gold_path) > 0 THEN (item_id % 2 = 0)::INT END), 4)::DOUBLE AS path_match, round(avg((item_id % 5) / 4.0), 4)::DOUBLE AS faithfulness, list_sort(list(item_id * 1.5))[floor(len(list(item_id)) * 0.5)::INT + 1]::DOUBLE AS p50, list_sort(list(item_id * 1.5))[floor(len(list(item_id)) * 0.95)::INT + 1]::DOUBLE AS p95 FROM eval_items""")
def a12_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select(
        F.lit("x").alias("gold_answer"), F.when(F.col("item_id") % 3 == 0, " X ").otherwise("y").alias("answer"), "gold_path", F.when(F.col("item_id") % 2 == 0, F.transform(F.slice("gold_path", 1, 1), lambda g: F.struct(F.lower(g["rel"]).alias("rel"), F.upper(g["obj"]).alias("obj")))).otherwise(F.array(F.struct(F.lit("a").alias("rel"), F.lit("b").alias("obj")))).alias("triples"), (F.col("item_id") % 5 / 4.0).alias("faithful"), (F.col("item_id") * 1.5).alias("latency")
    )
    return evaluate.report(e).select("n", F.round("exact_match", 4).alias("exact_match"), F.round("path_match", 4).alias("path_match"), F.round("faithfulness", 4).alias("faithfulness"), F.col("p50").cast("double").alias("p50"), F.col("p95").cast("double").alias("p95"))


@query("""WITH v AS (SELECT ts, (value * 100)::BIGINT AS x FROM events WHERE value IS NOT NULL) SELECT (list_sort(list(x))[floor(len(list(x)) * 0.95)::INT + 1])::BIGINT AS value FROM v""")
def a12_exact_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.exact_rank(table(spark, d, "events").select((F.col("value") * 100).cast("decimal(38,10)").alias("y")).select(F.round("y", 0).cast("long").alias("x")), "x", 0.95)


@query("SELECT item_id, round(g / 3.0, 3)::DOUBLE AS alignment, g / 3.0 >= 0.8 AS passed FROM (SELECT item_id, (item_id % 4)::INT AS g FROM eval_items WHERE item_id % 4 < 4) WHERE g <= 3")
def a13_alignment(spark: SparkSession, d: str) -> DataFrame:
    triple = F.array(F.struct(F.lit("Alpha").alias("subj"), F.lit("LED_BY").alias("rel"), F.lit("Beta").alias("obj"), F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("source")))
    good, bad = F.lit("alpha is led by beta"), F.lit("nothing of it")
    steps = F.array(*[F.when(F.col("item_id") % 4 > i, good).otherwise(bad) for i in range(3)])
    rows = table(spark, d, "eval_items").select("item_id", steps.alias("steps"), triple.alias("triples"))
    return explain.verify(rows).select("item_id", "alignment", "passed")


@query(r"SELECT pair_id, round(len(regexp_extract_all(src, '[A-Za-z]{1,4}|[0-9]|[^A-Za-z0-9 ]')) / greatest(1, len(list_filter(string_split_regex(trim(src), '\s+'), lambda w: w <> '')))::DOUBLE, 4)::DOUBLE AS fertility FROM parallel_pairs WHERE src IS NOT NULL")
def a14_fertility(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most four letters, single digits and marks, per word."""
    p = table(spark, d, "parallel_pairs").where("src is not null")
    tokens = F.regexp_extract_all("src", F.lit("([A-Za-z]{1,4}|[0-9]|[^A-Za-z0-9 ])"))
    return p.select("pair_id", F.round(corpus.fertility(tokens, F.col("src")), 4).alias("fertility"))


@query("""WITH t AS (SELECT session_id, request_id, ['e' || (request_id % 7), 'e' || (request_id % 3)] AS es, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS rn FROM (SELECT DISTINCT session_id, request_id FROM chat_requests WHERE session_id IS NOT NULL)),
x AS (SELECT a.session_id, a.request_id, b.rn, e.i, b.es[e.i] AS name FROM t a JOIN t b ON a.session_id = b.session_id AND b.rn BETWEEN a.rn - 4 AND a.rn, (SELECT unnest([1, 2]) AS i) e),
f AS (SELECT session_id, request_id, name, min(struct_pack(a := -rn, b := i)) AS first FROM x GROUP BY ALL)
SELECT session_id, request_id, string_agg(name, ',' ORDER BY first) AS context FROM f GROUP BY session_id, request_id""")
def w8_session_contexts(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.streaming.sessions import contexts

    turns = table(spark, d, "chat_requests").where("session_id is not null").select("session_id", "request_id").distinct()
    turns = turns.withColumn("entities", F.array(F.concat(F.lit("e"), (F.col("request_id") % 7).cast("string")), F.concat(F.lit("e"), (F.col("request_id") % 3).cast("string"))))
    return contexts(turns, order="request_id").select("session_id", "request_id", F.array_join("context", ",").alias("context"))


@query("SELECT 0 AS source_rank, 'part' AS source, p_partkey AS seq, p_name AS section FROM part UNION ALL SELECT 2, 'nation', n_nationkey, n_name FROM nation")
def u2_union_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda t, k, c: table(spark, d, t).select(F.col(k).alias("seq"), F.col(c).alias("section"))
    return readers.union_sources({"part": rows("part", "p_partkey", "p_name"), "region": rows("region", "r_regionkey", "r_name"), "nation": rows("nation", "n_nationkey", "n_name")}, ["part", "nation"])


@query(f"SELECT DISTINCT name, regexp_matches(trim(name), {_q(vocab.RESULT_NOISE)}) AS noise FROM entities WHERE name IS NOT NULL")
def f11_result_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("name is not null").select("name", text.is_result_noise(F.col("name")).alias("noise")).distinct()
