"""A small graph with known answers."""

from graphloom import schema
from graphloom.operators.graph import Graph

NODES = [
    ("infosys", "Infosys", "Company"), ("wipro", "Wipro", "Company"), ("sebi", "SEBI", "Regulator"), ("rbi", "RBI", "Regulator"), ("gdp", "GDP", "Indicator"),
    ("it_sector", "IT Sector", "Sector"), ("narayana_murthy", "N R Narayana Murthy", "Person"), ("salil_parekh", "Salil Parekh", "Person"),
]
EDGES = [
    ("infosys", "CEO_OF", "salil_parekh", "2018-01-02"), ("infosys", "OPERATES_IN", "it_sector", None), ("wipro", "OPERATES_IN", "it_sector", None), ("sebi", "REGULATES", "infosys", None),
    ("sebi", "REGULATES", "wipro", None), ("rbi", "INFLUENCES", "gdp", "2024-04-01"), ("narayana_murthy", "FOUNDED", "infosys", "1981-07-02"),
]


def toy_graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, name string, label string")
    edges = spark.createDataFrame([(f"e{i}", s, d, r, t, None, "toy") for i, (s, r, d, t) in enumerate(EDGES)], schema.EDGES)
    return Graph(nodes, edges, stored=True)


def graph_of(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, "id string, name string, label string"), spark.createDataFrame([(str(i), s, d, r, None, None, None) for i, (s, r, d) in enumerate(edges)], schema.EDGES))
