"""The query engine: a question to plan, paths, answer and explanation, over a graph of DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.functions import text
from graphloom.operators import paths, search, stats
from graphloom.operators.graph import Graph
from graphloom.plans import explain, questions
from graphloom.providers import Models, attempt
from graphloom.session import Cuts
from graphloom.streaming.sessions import SessionMemory


def rewritten(question: str) -> str:
    """The question with the synonyms' own words."""
    for pattern, value in vocab.SYNONYMS:
        question = re.sub(pattern, value, question, flags=re.IGNORECASE)
    return question


class GraphSource(Protocol):
    """What a graph must offer to the engine."""

    def search_nodes(self, text: str, top_k: int = 5) -> DataFrame: ...
    def get_neighbors(self, node_id: str, rel_types: list[str] | None = None, direction: str = "both", time_filter: dict | None = None) -> DataFrame: ...
    def find_paths(self, start_ids: list[str], end_ids: list[str] | None, constraints: dict | None = None, max_hops: int = 3, top_k: int = 3) -> DataFrame: ...
    def close(self) -> None: ...


class StoredGraph:
    """The graph of DataFrames as a source: undirected trails."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def search_nodes(self, text: str, top_k: int = 5) -> DataFrame:
        return search.search_nodes(self.graph, text, top_k)

    def get_neighbors(self, node_id: str, rel_types: list[str] | None = None, direction: str = "both", time_filter: dict | None = None) -> DataFrame:
        t = time_filter or {}
        return search.neighbours(self.graph, [node_id], rel_types, direction, t.get("after"), t.get("before"))

    def find_paths(self, start_ids: list[str], end_ids: list[str] | None, constraints: dict | None = None, max_hops: int = 3, top_k: int = 3) -> DataFrame:
        return paths.find_paths(self.graph, start_ids, end_ids, (constraints or {}).get("rel_types"), max_hops, top_k)

    def close(self) -> None:
        return None


class SmallGraph(StoredGraph):
    """The same source with directed simple paths, no constraint and no time filter, as small fixtures are searched."""

    def get_neighbors(self, node_id: str, rel_types: list[str] | None = None, direction: str = "both", time_filter: dict | None = None) -> DataFrame:
        return search.neighbours(self.graph, [node_id], rel_types, direction)

    def find_paths(self, start_ids: list[str], end_ids: list[str] | None, constraints: dict | None = None, max_hops: int = 3, top_k: int = 3) -> DataFrame:
        return paths.simple_paths(self.graph, start_ids, end_ids, max_hops, top_k)


@dataclass
class Answer:
    text: str
    confidence: float
    warn: bool
    paths: list[dict] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)
    plan: questions.Plan | None = None
    candidates: list[str] = field(default_factory=list)


class Engine:
    """``ask``, ``resolve``, ``describe`` and ``stats``. Every list it collects is cut to a top-k by the plan first.

    ``models`` may decompose, synthesise, explain and verify; what it lacks, declines or fails at is done by rule. The
    graph's edges are written once, unless it is a stored one.
    """

    def __init__(self, graph: Graph, source: GraphSource | None = None, top_k: int = 3, max_hops: int = 3, models: Models | None = None):
        self.cuts = Cuts(graph.nodes.sparkSession, "engine")
        self.graph = graph.store(self.cuts) if source is None else graph
        self.source, self.top_k, self.max_hops, self.models = source or StoredGraph(self.graph), top_k, max_hops, models or Models()
        self.memory = SessionMemory()

    def close(self) -> None:
        """Drop what the engine has written."""
        self.source.close()
        self.cuts.clear()

    def link(self, question: str, limit: int = 5) -> list[dict]:
        """Candidates of the first mention, longest first, that resolves by name or alias; else of the first by likeness.

        One scan tells which mentions can resolve at all."""
        found = questions.mentions(question)
        can = search.linkable(self.graph, found) if found else {"named": [], "alias": [], "alike": []}
        sure = sorted({*can["named"], *can["alias"]})
        for i in [*sure, *(i for i in can["alike"] if i not in sure)]:
            hits = [r.asDict() for r in search.resolve(self.graph, found[i], limit).collect()]
            if hits and (i not in sure or hits[0]["match_type"] != "fuzzy"):
                return hits
        return []

    def _ids(self, name: str | None, k: int) -> list[str]:
        return [r["id"] for r in self.source.search_nodes(name, k).collect()] if name else []

    def run_step(self, step: questions.SubQuestion, plan: questions.Plan, carried: list[str]) -> list[dict]:
        starts = self._ids(step.anchor, 5)[:3] or [c["id"] for c in self.link(step.text)][:3] or carried[:3]
        if not starts:
            return []
        ends = self._ids(step.target, 3) or None
        words = [w for w in dict.fromkeys("".join(c if c.isalnum() or c == "_" else " " for c in plan.question.lower()).split()) if len(w) > 3]
        rels = plan.relations or ([step.relation] if step.relation else None)
        found = self.source.find_paths(starts, ends, {"rel_types": rels}, self.max_hops, 3 * self.top_k)
        ranked = paths.score_paths(found, plan.confidence, plan.after, plan.before, words, top_k=self.top_k)
        rows = [r.asDict(recursive=True) for r in ranked.collect()]
        if not rows:  # the neighbourhood of the starts, then of the target
            for ids in (starts, ends or []):
                if ids and not rows:
                    near = paths.neighbour_paths(search.neighbours(self.graph, ids, rels, after=plan.after, before=plan.before))
                    rows = [r.asDict(recursive=True) for r in paths.score_paths(near, plan.confidence, plan.after, plan.before, words, top_k=self.top_k).collect()]
        return rows

    def run(self, plan: questions.Plan) -> tuple[list[dict], list[str]]:
        """Best paths of all steps, and the last step's end nodes as candidates."""
        best: dict[str, dict] = {}
        candidates, carried = [], []
        for step in plan.steps:
            rows = self.run_step(step, plan, carried)
            for r in rows:
                best.setdefault(r["path_id"], r)
            candidates = list(dict.fromkeys(r["node_names"][-1] for r in rows))
            carried = [rows[0]["node_ids"][-1]] if rows else carried
        return sorted(best.values(), key=lambda r: (-r["score"], r["hops"], r["path_id"]))[: self.top_k], candidates

    def ask(self, question: str, session: str = "default") -> Answer:
        context = self.memory.context(session)
        plan = questions.plan_question(rewritten(question.strip()), context["entities"], context["event"])
        parts = self.models.decompose and attempt(self.models.decompose, plan.question)
        if parts:
            plan.steps = [questions.SubQuestion(i, p, relation=plan.relations[0] if plan.relations else None) for i, p in enumerate(parts)]
        best, candidates = self.run(plan)
        spark = self.graph.nodes.sparkSession
        seen, triples = set(), []
        for r in best:
            for t in r["triples"]:
                if (key := (t["subj"], t["rel"], t["obj"])) not in seen:
                    seen.add(key)
                    triples.append(t)
        shape = "array<struct<subj:string,rel:string,obj:string,time:string,source:string>>"
        top = best[0]["triples"] if best else []
        # answer, steps and their check in one local row
        row = spark.createDataFrame([(triples if best else None, candidates, plan.kind, top)], f"all {shape}, candidates array<string>, kind string, triples {shape}")
        row = row.withColumn("said", explain.answer(F.col("all"), F.col("candidates"), F.col("kind"))).withColumn("lines", F.transform(F.coalesce("all", F.array().cast(shape)), explain.triple_line))
        told = explain.verify(explain.steps(row)).first()
        lines = told["lines"]
        said = (best and self.models.synthesise and attempt(self.models.synthesise, plan.question, lines)) or told["said"]
        steps = told["verified"]
        if best and self.models.explain and (own := attempt(self.models.explain, plan.question, lines)):
            check = self.models.verify
            asked = spark.createDataFrame([([s for s in own if s.strip()], top)], f"steps array<string>, triples {shape}").withColumn("steps", F.filter("steps", text.is_step_line))
            checked = explain.verify(asked).first()
            # a step that no model judges is judged by its words
            judged = [(s, attempt(check, s, lines) if check else None) for s in checked["steps"]]
            steps = [s for s, ok in judged if (s in checked["verified"] if ok is None else ok)] or steps
        names = list(dict.fromkeys(n for r in best for n in r["node_names"]))
        events = [n for r in best for n, label in zip(r["node_names"], r["node_labels"]) if label == "Event"]
        self.memory.add(session, question, said, names, [i for r in best for i in r["node_ids"]], events)
        score = best[0]["score"] if best else 0.0
        return Answer(said, score, score < 0.60, best, steps if best else [], names, list(dict.fromkeys(t["source"] for t in triples if t["source"])), plan, candidates)

    def resolve(self, mention: str, top_k: int = 5) -> DataFrame:
        return search.resolve(self.graph, mention, top_k)

    def translate(self, texts: DataFrame, column: str, *translators) -> DataFrame:
        from graphloom.providers import translated

        return texts.withColumn("normal", text.normalise_english(translated(F.col(column), *translators))).withColumn("script", text.detect_script(F.col(column)))

    def stats(self) -> DataFrame:
        return stats.graph_stats(self.graph)

    def health(self) -> dict:
        return {"nodes": self.graph.nodes.limit(1).count() > 0, "labels": list(vocab.NODE_LABELS)}

    def describe(self, question: str, limit: int = 15) -> str:
        """The linked entity and its first relations as text."""
        hits = self.link(question, 1)
        if not hits:
            return "Sorry, I couldn't find any matching entity in the Knowledge Graph. Try rephrasing with a company name, sector, or financial indicator."
        e = hits[0]
        rows = search.neighbours(self.graph, [e["id"]], limit=limit).orderBy("eid").collect()
        lines = [f"**{e['name']}** [{e['label']}]  (matched via {e['match_type']})\n", f"Top {len(rows)} relationships:\n"]
        lines += [f"  {r['from_name']}  {'→' if r['direction'] == 'outgoing' else '←'}[{r['rel']}]→  {r['to_name']}  [{r['to_label'] or '?'}]" for r in rows]
        return "\n".join(lines)
