"""Queries of the graph engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms
from trellis.functions.prefixes import RDF_TYPE, XSD, compact_column
from trellis.operators import checks, experiments, profile, quality
from trellis.operators.matching import match_columns
from trellis.plans import rules, shacl, sparql
from trellis.plans.closure import shared_folder
from trellis.plans.mapping import parse
from trellis.plans.materialize import compile_mapping, drop_literal_types, keyword_triples
from trellis.plans.store import TripleStore, write_store
from trellis.sources import ntriples
from trellis.sources.ontology import read_ontology

KG = "http://kg.test/"
HEAD = f"prefixes:\n  kg: {KG}\n  xsd: {XSD}\nmappings:\n"
ORDERS = """
  OrderMapping:
    sources: [[orders~parquet]]
    s: kg:Order/$(o_orderkey)
    po:
      - [a, kg:Order]
      - [kg:status, $(o_orderstatus)]
      - [kg:priority, $(o_orderpriority), xsd:string]
      - [kg:date, $(o_orderdate), xsd:dateTime]
      - [kg:placedBy, kg:Customer/$(o_custkey)~iri]
"""
CUSTOMERS = """
  CustomerMapping:
    sources: [[customer~parquet]]
    s: kg:Customer/$(c_custkey)
    po:
      - [a, kg:Customer]
      - [kg:name, $(c_name), xsd:string]
      - [kg:segment, $(c_mktsegment)]
      - [kg:nation, kg:Nation/$(c_nationkey)~iri]
"""
NATIONS = """
  NationMapping:
    sources: [[nation~parquet]]
    s: kg:Nation/$(n_nationkey)
    po:
      - [a, kg:Nation]
      - [kg:label, $(n_name)]
      - [kg:within, kg:Region/$(n_regionkey)~iri]
  RegionMapping:
    sources: [[region~parquet]]
    s: kg:Region/$(r_regionkey)
    po:
      - [a, kg:Region]
      - [kg:label, $(r_name)]
      - [kg:within, kg:World~iri]
"""
PARTS = """
  PartMapping:
    sources: [[part~parquet]]
    s: kg:Part/$(p_partkey)
    po:
      - [a, kg:Part]
      - [kg:brand, $(p_brand)]
      - [kg:size, $(p_size), xsd:integer]
"""
#: A customer's segment is a class too.
SEGMENTS = """
  SegmentMapping:
    sources: [[customer~parquet]]
    s: kg:Customer/$(c_custkey)
    po:
      - [a, kg:$(c_mktsegment)~iri]
"""
SHOWN = ["s", "p", "o", "o_kind", "o_datatype"]


class Tables(dict):
    """Tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and name.isidentifier()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graph(t: Tables, *parts: str, apart: bool = False) -> DataFrame:
    return compile_mapping(parse(HEAD + "".join(parts)), t, apart=apart)


_stores: dict[tuple, TripleStore] = {}


def store(t: Tables) -> TripleStore:
    """The store of all five tables, which the queries of a session share while the tables stay as they are."""
    jvm, conf, state = t.spark._jvm, t.spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in ("orders", "customer", "nation", "region", "part"):
        path = jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{name}.parquet")
        found = path.getFileSystem(conf).getFileStatus(path)
        state.append((str(found.getPath()), found.getModificationTime(), found.getLen()))
    key = (t.spark.sparkContext.applicationId, *state)
    if key not in _stores:
        _stores[key] = write_store(graph(t, ORDERS, CUSTOMERS, SEGMENTS, NATIONS, PARTS))
    return _stores[key]


def arm(s: str, p: str, o: str, table: str, kind: str = "lit", datatype: str = "NULL", where: str = "TRUE") -> str:
    d = datatype if datatype == "NULL" else f"'{XSD}{datatype}'"
    p = RDF_TYPE if p == "a" else KG + p
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, CAST({d} AS VARCHAR) AS o_datatype FROM {table} WHERE {where}"


def iri(kind: str, column: str) -> str:
    return f"'{KG}{kind}/' || CAST({column} AS VARCHAR)"


def union(*arms: str) -> str:
    return " UNION ".join(arms)


O, C, N, R, P = iri("Order", "o_orderkey"), iri("Customer", "c_custkey"), iri("Nation", "n_nationkey"), iri("Region", "r_regionkey"), iri("Part", "p_partkey")
ORDER_ARMS = [
    arm(O, "a", f"'{KG}Order'", "orders", "iri"),
    arm(O, "status", "o_orderstatus", "orders"),
    arm(O, "priority", "o_orderpriority", "orders"),
    arm(O, "date", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "orders", datatype="dateTime"),
    arm(O, "placedBy", iri("Customer", "o_custkey"), "orders", "iri"),
]
CUSTOMER_ARMS = [arm(C, "a", f"'{KG}Customer'", "customer", "iri"), arm(C, "name", "c_name", "customer"), arm(C, "segment", "c_mktsegment", "customer"), arm(C, "nation", iri("Nation", "c_nationkey"), "customer", "iri")]


# Materialisation


@query(arm(C, "a", f"'{KG}Customer'", "customer", "iri"))
def materialize_type_triples(t):
    return graph(t, CUSTOMERS.split("      - [kg:name")[0]).select(*SHOWN)


@query(union(CUSTOMER_ARMS[1], CUSTOMER_ARMS[2]))
def materialize_literals(t):
    return graph(t, CUSTOMERS).where("o_kind = 'lit'").select(*SHOWN)


@query(union(arm(P, "size", "CAST(p_size AS VARCHAR)", "part", datatype="integer"), ORDER_ARMS[3]))
def materialize_typed_literals(t):
    return graph(t, PARTS, ORDERS).where("o_datatype IS NOT NULL").select(*SHOWN)


@query(union(ORDER_ARMS[4], CUSTOMER_ARMS[3]))
def materialize_iri_links(t):
    return graph(t, ORDERS, CUSTOMERS).where((F.col("o_kind") == "iri") & (F.col("p") != RDF_TYPE)).select(*SHOWN)


@query(union(*ORDER_ARMS, *CUSTOMER_ARMS, arm(P, "a", f"'{KG}Part'", "part", "iri"), arm(P, "brand", "p_brand", "part"), arm(P, "size", "CAST(p_size AS VARCHAR)", "part", datatype="integer")))
def materialize_multi_map(t):
    return graph(t, ORDERS, CUSTOMERS, PARTS).select(*SHOWN)


@query(union(arm(P, "size", "CAST(nullif(p_size, 7) AS VARCHAR)", "part", datatype="integer", where="p_size <> 7"), arm(iri("Brand", "replace(p_brand, '#', '%23')"), "size", "CAST(p_size AS VARCHAR)", "part", datatype="integer", where="p_size <> 7")))
def materialize_null_drop(t):
    t["part"] = t["part"].withColumn("p_size", F.nullif("p_size", F.lit(7)))
    more = "\n  BrandMapping:\n    sources: [[part~parquet]]\n    s: kg:Brand/$(p_brand)\n    po:\n      - [kg:size, $(p_size), xsd:integer]\n"
    return graph(t, PARTS, more).where(F.col("p") == KG + "size").select(*SHOWN)


@query(union(arm("'" + KG + "Line/' || l_orderkey || '/' || l_linenumber", "a", f"'{KG}Line'", "lineitem", "iri"), arm("'" + KG + "Line/' || l_orderkey || '/' || l_linenumber", "flag", "l_returnflag", "lineitem")))
def materialize_distinct(t):
    return graph(t, "\n  L:\n    sources: [[lineitem~parquet]]\n    s: kg:Line/$(l_orderkey)/$(l_linenumber)\n    po:\n      - [a, kg:Line]\n      - [kg:flag, $(l_returnflag)]\n").select(*SHOWN)


@query("SELECT count(*) AS removed FROM (SELECT DISTINCT c_custkey FROM customer)")
def clean_type_literals(t):
    g = graph(t, CUSTOMERS)
    bad = g.where(F.col("p") == RDF_TYPE).withColumn("o_kind", F.lit("lit"))
    return drop_literal_types(g.where(F.col("p") != RDF_TYPE).unionByName(bad))[1]


@query("SELECT DISTINCT * FROM (" + arm("'" + KG + "Supply/' || l_partkey || '_' || l_suppkey || '/Metadata'", "a", f"'{KG}SupplyMetadata'", "lineitem", "iri") + ")")
def template_composite_key(t):
    doc = parse(HEAD + "\n  M:\n    sources: [[lineitem~parquet]]\n    s: kg:Supply/$(l_partkey)_$(l_suppkey)/Metadata\n    po:\n      - [a, kg:Supply]\n")
    return compile_mapping(rules.metadata_classes(doc, rules.Context()), t).select(*SHOWN)


@query(union(arm(P, "unit", "'piece'", "part"), arm(P, "kind", f"'{KG}Thing'", "part", "iri")))
def constant_literal(t):
    return graph(t, '\n  P:\n    sources: [[part~parquet]]\n    s: kg:Part/$(p_partkey)\n    po:\n      - [kg:unit, "piece", xsd:string]\n      - [kg:kind, kg:Thing~iri]\n').select(*SHOWN)


@query(union(*(arm(f"'{KG}Trait/' || p_partkey || '/{n}'", q, v, "part") for n in ("brand", "type") for q, v in (("trait", f"'{n}'"), ("value", f"p_{n}")))))
def unpivot_columns(t):
    each = "".join(f'\n  M{n}:\n    sources: [[part~parquet]]\n    s: kg:Trait/$(p_partkey)/{n}\n    po:\n      - [kg:trait, "{n}", xsd:string]\n      - [kg:value, $(p_{n})]\n' for n in ("brand", "type"))
    return graph(t, each).select(*SHOWN)


@query(f"SELECT DISTINCT {O} AS s, '{KG}buyer' AS p, '{KG}Client/' || replace(c_name, '#', '%23') AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype FROM orders JOIN customer ON o_custkey = c_custkey")
def join_object_map(t):
    both = "\n  A:\n    sources: [[orders~parquet]]\n    s: kg:Order/$(o_orderkey)\n    po:\n      - [kg:buyer, B~iri, {joins: {child: o_custkey, parent: c_custkey}}]\n  B:\n    sources: [[customer~parquet]]\n    s: kg:Client/$(c_name)\n    po:\n      - [a, kg:Client]\n"
    return graph(t, both).where(F.col("p") == KG + "buyer").select(*SHOWN)


@query(union(arm(O, "buyer", iri("Customer", "o_custkey"), "orders", "iri")))
def fk_template_link(t):
    both = "\n  A:\n    sources: [[orders~parquet]]\n    s: kg:Order/$(o_orderkey)\n    po:\n      - [kg:buyer, B~iri, {joins: {child: o_custkey, parent: o_custkey}}]\n  B:\n    sources: [[orders~parquet]]\n    s: kg:Customer/$(o_custkey)\n    po:\n      - [a, kg:Customer]\n"
    return graph(t, both).where(F.col("p") == KG + "buyer").select(*SHOWN)


@query(f"SELECT '<{KG}Nation/' || n_nationkey || '> <{KG}label> \"' || n_name || '\" .' AS line FROM nation")
def ntriples_lines(t):
    return graph(t, NATIONS.split("  RegionMapping")[0]).where("o_kind = 'lit'").select(ntriples.line().alias("line"))


@query(f"SELECT '{KG}Nation/' || n_nationkey AS s, 'x\"' || n_name AS o FROM nation")
def ntriples_parse(t):
    lines = graph(t, NATIONS.split("  RegionMapping")[0]).where("o_kind = 'lit'").withColumn("o", F.concat(F.lit('x"'), "o")).select(ntriples.line().alias("value"))
    return ntriples.parse(lines).select("s", "o")


@query(f"SELECT '{KG}Nation/' || n_nationkey AS s, '{KG}label' AS p, n_name AS o FROM nation WHERE lower('{KG}Nation/' || n_nationkey || ' {KG}label ' || n_name) LIKE '%an%' ORDER BY 1, 2, 3 LIMIT 50")
def keyword_filter(t):
    return keyword_triples(graph(t, NATIONS.split("  RegionMapping")[0]).where("o_kind = 'lit'"), ["an"])


# Queries


#: Queries that go to the shared store; the others compile their own mappings, and read no more than they look up.
STORED = ("count_instances", "sparql_optional", "sparql_minus", "sparql_exists", "sparql_loose_join", "sparql_path_sequence", "sparql_path_inverse_or", "sparql_group_having")


def sparql_query(text: str, *parts: str, sql: str, name: str):
    def f(t):
        if name in STORED:
            return store(t).run(text, {"kg": KG, "xsd": XSD})
        return sparql.run(text, graph(t, *parts, apart=True), {"kg": KG, "xsd": XSD})

    f.__name__ = name
    query(sql)(f)


JOINED = "orders JOIN customer ON o_custkey = c_custkey"
for _name, _text, _parts, _sql in [
    ("ask_type_exists", "ASK { ?o a kg:Order }", (ORDERS,), "SELECT count(*) > 0 AS ask FROM orders"),
    ("ask_star", 'ASK { ?o a kg:Order ; kg:status "F" ; kg:priority "1-URGENT" }', (ORDERS,), "SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    ("ask_chain_join", 'ASK { ?o kg:placedBy ?c . ?c kg:segment "BUILDING" }', (ORDERS, CUSTOMERS), f"SELECT count(*) > 0 AS ask FROM {JOINED} WHERE c_mktsegment = 'BUILDING'"),
    ("ask_filter_or", 'ASK { ?o kg:status ?x FILTER(?x = "Z" || ?x = "O") }', (ORDERS,), "SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus IN ('Z', 'O')"),
    ("ask_missing_false", "ASK { ?o a kg:Order ; kg:segment ?s }", (ORDERS, CUSTOMERS), "SELECT FALSE AS ask"),
    ("ask_disconnected", 'ASK { ?o kg:status "F" . ?c kg:segment "BUILDING" }', (ORDERS, CUSTOMERS), "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0 AND (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 0 AS ask"),
    ("select_distinct_types", "SELECT DISTINCT ?t WHERE { ?s a ?t }", (ORDERS, CUSTOMERS), f"SELECT * FROM (VALUES ('{KG}Order'), ('{KG}Customer')) AS v(t)"),
    ("select_distinct_predicates", "SELECT DISTINCT ?p WHERE { ?s ?p ?o } LIMIT 60", (CUSTOMERS,), f"SELECT * FROM (VALUES ('{RDF_TYPE}'), ('{KG}name'), ('{KG}segment'), ('{KG}nation')) AS v(p)"),
    ("count_instances", 'SELECT (COUNT(?o) AS ?cnt) WHERE { ?o a kg:Order ; kg:placedBy ?c . ?c kg:segment "BUILDING" }', (ORDERS, CUSTOMERS), f"SELECT count(DISTINCT o_orderkey) AS cnt FROM {JOINED} WHERE c_mktsegment = 'BUILDING'"),
    ("sparql_optional", "SELECT ?c ?o WHERE { ?c a kg:Customer OPTIONAL { ?o kg:placedBy ?c ; kg:status \"P\" } }", (ORDERS, CUSTOMERS), f"SELECT {C} AS c, {O} AS o FROM customer LEFT JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey"),
    ("sparql_union", '{ }', (), ""),
    ("sparql_minus", "SELECT ?c WHERE { ?c a kg:Customer MINUS { ?o kg:placedBy ?c } }", (ORDERS, CUSTOMERS), f"SELECT {C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    ("sparql_minus_unrelated", "SELECT ?n WHERE { ?n a kg:Nation MINUS { ?x a kg:Region } }", (NATIONS,), f"SELECT {N} AS n FROM nation"),
    ("sparql_exists", 'SELECT ?c WHERE { ?c kg:segment "MACHINERY" FILTER EXISTS { ?o kg:placedBy ?c ; kg:priority "1-URGENT" } }', (ORDERS, CUSTOMERS), f"SELECT {C} AS c FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    ("sparql_bind_filter", "SELECT ?p ?double WHERE { ?p kg:size ?n BIND(?n * 2 AS ?double) FILTER(?double > 90) }", (PARTS,), f"SELECT {P} AS p, CAST(p_size * 2 AS VARCHAR) AS double FROM part WHERE p_size * 2 > 90"),
    ("sparql_values", 'SELECT ?c ?x WHERE { VALUES ?x { "BUILDING" "MACHINERY" } ?c kg:segment ?x }', (CUSTOMERS,), f"SELECT {C} AS c, c_mktsegment AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("sparql_group_having", "SELECT ?x (COUNT(?c) AS ?n) WHERE { ?c kg:nation ?x } GROUP BY ?x HAVING(COUNT(?c) > 50)", (CUSTOMERS,), f"SELECT {iri('Nation', 'c_nationkey')} AS x, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 50"),
    ("sparql_aggregates", "SELECT ?b (SUM(?n) AS ?total) (AVG(?n) AS ?mean) (MIN(?n) AS ?least) (MAX(?n) AS ?most) WHERE { ?p kg:brand ?b ; kg:size ?n } GROUP BY ?b", (PARTS,), "SELECT p_brand AS b, CAST(sum(p_size) AS DOUBLE) AS total, avg(CAST(p_size AS DOUBLE)) AS mean, CAST(min(p_size) AS VARCHAR) AS least, CAST(max(p_size) AS VARCHAR) AS most FROM part GROUP BY p_brand"),
    ("sparql_avg_distinct", "SELECT ?b (AVG(DISTINCT ?n) AS ?mean) (SUM(DISTINCT ?n) AS ?total) (COUNT(DISTINCT ?n) AS ?k) WHERE { ?p kg:brand ?b ; kg:size ?n } GROUP BY ?b", (PARTS,), "SELECT p_brand AS b, avg(DISTINCT CAST(p_size AS DOUBLE)) AS mean, CAST(sum(DISTINCT p_size) AS DOUBLE) AS total, count(DISTINCT p_size) AS k FROM part GROUP BY p_brand"),
    ("sparql_loose_join", 'SELECT ?c ?l WHERE { ?c kg:segment "BUILDING" OPTIONAL { ?c kg:nation ?n } ?n kg:label ?l }', (CUSTOMERS, NATIONS), f"SELECT {C} AS c, n_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    ("ask_disconnected_false", 'ASK { ?o kg:status "F" . ?c kg:segment "NONE" }', (ORDERS, CUSTOMERS), "SELECT FALSE AS ask"),
    ("sparql_order_limit", "SELECT ?p ?n WHERE { ?p kg:size ?n } ORDER BY DESC(?n) ?p OFFSET 3 LIMIT 20", (PARTS,), f"SELECT {P} AS p, CAST(p_size AS VARCHAR) AS n FROM part ORDER BY p_size DESC, 1 LIMIT 20 OFFSET 3"),
    ("sparql_path_plus", "SELECT ?a ?b WHERE { ?a kg:within+ ?b }", (NATIONS,), f"SELECT {N} AS a, {iri('Region', 'n_regionkey')} AS b FROM nation UNION SELECT {N}, '{KG}World' FROM nation UNION SELECT {R}, '{KG}World' FROM region"),
    ("sparql_path_sequence", "SELECT ?c ?l WHERE { ?c kg:nation/kg:within/kg:label ?l }", (CUSTOMERS, NATIONS), f"SELECT {C} AS c, r_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    ("sparql_path_inverse_or", "SELECT DISTINCT ?x WHERE { ?x (^kg:placedBy|^kg:nation)/kg:segment ?s }", (CUSTOMERS, ORDERS), f"SELECT DISTINCT {iri('Nation', 'c_nationkey')} AS x FROM customer"),
    ("sparql_functions", 'SELECT ?c ?u WHERE { ?c kg:name ?n ; kg:segment ?x BIND(CONCAT(LCASE(?x), "-", STR(STRLEN(?n))) AS ?u) FILTER(REGEX(?n, "7$") && STRSTARTS(?x, "B")) }', (CUSTOMERS,), f"SELECT {C} AS c, lower(c_mktsegment) || '-' || length(c_name) AS u FROM customer WHERE c_name LIKE '%7' AND c_mktsegment LIKE 'B%'"),
    ("sparql_subselect", "SELECT ?x ?l ?n WHERE { { SELECT ?x (COUNT(?c) AS ?n) WHERE { ?c kg:nation ?x } GROUP BY ?x } ?x kg:label ?l }", (CUSTOMERS, NATIONS), f"SELECT {N} AS x, n_name AS l, CAST(n AS VARCHAR) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey"),
]:
    if _name == "sparql_union":
        _text, _parts = "SELECT ?s ?l WHERE { { ?s kg:segment ?l } UNION { ?s kg:label ?l } }", (CUSTOMERS, NATIONS)
        _sql = f"SELECT {C} AS s, c_mktsegment AS l FROM customer UNION ALL SELECT {N}, n_name FROM nation UNION ALL SELECT {R}, r_name FROM region"
    sparql_query(_text, *_parts, sql=_sql, name=_name)


# What an inner filter sees, unbound variables, exact values, graphs as results

BIG = 9007199254740993
for _name, _text, _parts, _sql in [
    ("sparql_exists_correlated", "SELECT ?p ?n WHERE { ?p kg:brand ?b ; kg:size ?n FILTER NOT EXISTS { ?q kg:brand ?b ; kg:size ?m FILTER(?m > ?n) } }", (PARTS,), f"SELECT {P} AS p, CAST(p_size AS VARCHAR) AS n FROM part a WHERE p_size = (SELECT max(p_size) FROM part b WHERE b.p_brand = a.p_brand)"),
    ("sparql_exists_outer_filter", "SELECT ?p WHERE { ?p kg:brand ?b ; kg:size ?n FILTER EXISTS { ?q kg:brand ?b ; kg:size ?m FILTER(?m > ?n + 20) } }", (PARTS,), f"SELECT {P} AS p FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size > a.p_size + 20)"),
    ("sparql_exists_in_expression", "SELECT ?p ?far WHERE { ?p kg:brand ?b ; kg:size ?n BIND(EXISTS { ?q kg:brand ?b ; kg:size ?m FILTER(?m > ?n + 40) } AS ?far) FILTER(?n > 45 || EXISTS { ?q kg:brand ?b ; kg:size ?m FILTER(?m < ?n - 40) } || ?far) }", (PARTS,), f"SELECT {P} AS p, CAST(far AS VARCHAR) AS far FROM (SELECT *, EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size > a.p_size + 40) AS far, EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size < a.p_size - 40) AS near FROM part a) WHERE p_size > 45 OR near OR far"),
    ("sparql_minus_unbound", 'SELECT ?c ?x WHERE { ?c a kg:Customer OPTIONAL { ?c kg:segment ?x FILTER(?x != "MACHINERY") } MINUS { VALUES ?x { "BUILDING" } } }', (CUSTOMERS,), f"SELECT {C} AS c, nullif(c_mktsegment, 'MACHINERY') AS x FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    ("sparql_optional_unbound", 'SELECT ?c ?n ?l WHERE { ?c kg:segment "BUILDING" OPTIONAL { ?c kg:nation ?n FILTER(?n != kg:Nation/7) } OPTIONAL { ?n kg:label ?l } FILTER(BOUND(?l)) }'.replace("kg:Nation/7", f"<{KG}Nation/7>"), (CUSTOMERS, NATIONS), f"SELECT {C} AS c, CASE WHEN c_nationkey <> 7 THEN {iri('Nation', 'c_nationkey')} ELSE s END AS n, CASE WHEN c_nationkey <> 7 THEN n_name ELSE l END AS l FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT {N} AS s, n_name AS l FROM nation UNION ALL SELECT {R}, r_name FROM region) ON c_nationkey = 7 WHERE c_mktsegment = 'BUILDING'"),
    ("sparql_instants", 'SELECT ?o WHERE { ?o kg:date ?d FILTER(?d >= "1995-03-15T05:00:00+05:00"^^xsd:dateTime && ?d < "1995-04-14T19:00:00-05:00"^^xsd:dateTime) }', (ORDERS,), f"SELECT {O} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-15 00:00:00' AND o_orderdate < TIMESTAMP '1995-04-15 00:00:00'"),
    ("sparql_exact_sum", f"SELECT ?b (STR(SUM(?v)) AS ?total) (DATATYPE(SUM(?v)) AS ?kind) WHERE {{ ?p kg:brand ?b ; kg:size ?n BIND(?n + {BIG} AS ?v) }} GROUP BY ?b", (PARTS,), f"SELECT p_brand AS b, CAST(sum(CAST(p_size AS HUGEINT) + {BIG}) AS VARCHAR) AS total, '{XSD}integer' AS kind FROM part GROUP BY p_brand"),
    ("sparql_exact_compare", f"SELECT ?p WHERE {{ ?p kg:size ?n FILTER(?n + {BIG} = {BIG + 7} || ?n + {BIG} > {BIG + 49}) }}", (PARTS,), f"SELECT {P} AS p FROM part WHERE p_size = 7 OR p_size > 49"),
    ("sparql_round_half", "SELECT ?p (STR(ROUND((0 - ?n) / 2)) AS ?half) WHERE { ?p kg:size ?n }", (PARTS,), f"SELECT {P} AS p, CAST(CAST(floor(-p_size / 2 + 0.5) AS INTEGER) AS VARCHAR) AS half FROM part"),
    ("sparql_case_of_names", "SELECT ?c ?C WHERE { ?c kg:nation ?C . ?C kg:label ?_l FILTER(?_l = 'NATION_3') }", (CUSTOMERS, NATIONS), None),
    ("sparql_construct", "CONSTRUCT { ?c kg:lives ?l . _:k kg:of ?c } WHERE { ?c kg:nation/kg:label ?l }", (CUSTOMERS, NATIONS), None),
    ("sparql_describe", 'DESCRIBE ?n WHERE { ?n kg:label ?l FILTER(STRSTARTS(?l, "NATION_")) }', (NATIONS,), f"SELECT * FROM ({union(arm(N, 'a', f'{chr(39)}{KG}Nation{chr(39)}', 'nation', 'iri'), arm(N, 'label', 'n_name', 'nation'), arm(N, 'within', iri('Region', 'n_regionkey'), 'nation', 'iri'))}) WHERE s IN (SELECT {N} FROM nation WHERE n_name LIKE 'NATION_%')"),
    ("sparql_path_complement", f"SELECT ?x ?y WHERE {{ ?x !(a|kg:label|^kg:within) ?y }}", (NATIONS,), f"SELECT {N} AS x, {iri('Region', 'n_regionkey')} AS y FROM nation UNION ALL SELECT {R}, '{KG}World' FROM region UNION ALL SELECT '{KG}Nation', {N} FROM nation UNION ALL SELECT '{KG}Region', {R} FROM region UNION ALL SELECT n_name, {N} FROM nation UNION ALL SELECT r_name, {R} FROM region"),
    ("sparql_path_zero_length", f"SELECT ?y WHERE {{ <{KG}Nowhere> kg:within* ?y }}", (NATIONS,), f"SELECT '{KG}Nowhere' AS y"),
    ("sparql_path_from", f"SELECT ?y WHERE {{ <{KG}Nation/3> kg:within+ ?y }}", (NATIONS,), f"SELECT {iri('Region', 'n_regionkey')} AS y FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{KG}World'"),
    ("sparql_hash_functions", "SELECT ?c ?m ?u WHERE { ?c kg:name ?n BIND(SHA256(?n) AS ?m) BIND(ENCODE_FOR_URI(?n) AS ?u) }", (CUSTOMERS,), f"SELECT {C} AS c, sha256(c_name) AS m, replace(c_name, '#', '%23') AS u FROM customer"),
    ("sparql_blank_property_list", 'SELECT ?o WHERE { ?o kg:placedBy [ kg:segment "BUILDING" ; kg:nation [ kg:label "NATION_3" ] ] }', (ORDERS, CUSTOMERS, NATIONS), f"SELECT {O} AS o FROM {JOINED} JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_3'"),
]:
    if _name == "sparql_case_of_names":
        # The result's names may differ in case only; compared here under others.
        query(f"SELECT {C} AS c, {iri('Nation', 'c_nationkey')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")(lambda t, q=_text: sparql.run(q, graph(t, CUSTOMERS, NATIONS, apart=True), {"kg": KG}).toDF("c", "n"))
        QUERIES[_name], SQL[_name] = QUERIES.pop("<lambda>"), SQL.pop("<lambda>")
    elif _name == "sparql_construct":
        # Blank nodes have names of their own, one for each solution; compared here without them.
        query(f"SELECT {C} AS s, '{KG}lives' AS p, n_name AS o, 'lit' AS o_kind FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'blank', '{KG}of', {C}, 'iri' FROM customer")(lambda t, q=_text: sparql.run(q, graph(t, CUSTOMERS, NATIONS, apart=True), {"kg": KG}).select(F.when(F.col("s_kind") == "bnode", "blank").otherwise(F.col("s")).alias("s"), "p", "o", "o_kind"))
        QUERIES[_name], SQL[_name] = QUERIES.pop("<lambda>"), SQL.pop("<lambda>")
    elif _name == "sparql_describe":
        query(_sql)(lambda t, q=_text: sparql.run(q, graph(t, NATIONS), {"kg": KG}).select(*SHOWN))
        QUERIES[_name], SQL[_name] = QUERIES.pop("<lambda>"), SQL.pop("<lambda>")
    else:
        sparql_query(_text, *_parts, sql=_sql, name=_name)


# Profiles and names


@query("SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS \"column\", unnest([count(DISTINCT p_partkey) = count(*), count(DISTINCT p_name) = count(*), count(DISTINCT p_brand) = count(*), count(DISTINCT p_type) = count(*), count(DISTINCT p_size) = count(*), count(DISTINCT p_retailprice) = count(*)]) AS is_unique FROM part")
def profile_unique_columns(t):
    return profile.profile(t["part"]).select("column", "is_unique")


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) AS \"column\", unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority)]) AS n_distinct, count(*) AS n_rows FROM orders")
def profile_cardinality(t):
    return profile.profile(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select("column", "n_distinct", "n_rows")


@query("SELECT unnest(['a', 'b', 'c']) AS \"column\", unnest([FALSE, TRUE, TRUE]) AS is_empty")
def profile_empty_columns(t):
    return profile.profile(t["part"].select(F.col("p_name").alias("a"), F.lit("  ").alias("b"), F.lit(None).cast("string").alias("c"))).select("column", "is_empty")


@query("SELECT 'c_custkey' AS \"column\", FALSE AS named_like_key FROM (SELECT count(*) AS n, count(DISTINCT c_custkey) AS d FROM customer) WHERE n = d UNION ALL SELECT 'c_name', FALSE FROM (SELECT count(*) AS n, count(DISTINCT c_name) AS d FROM customer) WHERE n = d")
def pk_candidates(t):
    return profile.key_candidates(t["customer"].select("c_custkey", "c_name", "c_mktsegment")).select("column", "named_like_key")


@query("SELECT \"column\", CASE WHEN d < greatest(5, 0.1 * n) THEN 'low' WHEN d >= 0.5 * n THEN 'high' ELSE 'mid' END AS level FROM (SELECT 'p_partkey' AS \"column\", count(DISTINCT p_partkey) AS d, count(*) AS n FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), count(*) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size), count(*) FROM part)")
def low_high_cardinality(t):
    return profile.cardinality(t["part"].select("p_partkey", "p_brand", "p_size"), None).select("column", "level")


@query("SELECT 'c' || c_custkey AS \"group\", CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey || '_lat' END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '_longitude' END AS long FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def coord_groups(t):
    """Columns of a table that is as wide as there are customers; some have half a pair, and what only ends alike is none."""
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    names = F.array(F.when(F.col("c_custkey") % 3 != 0, F.concat(key, F.lit("_lat"))), F.when(F.col("c_custkey") % 2 == 0, F.concat(key, F.lit("_longitude"))), F.concat(key, F.lit("_along")))
    return profile.coordinate_groups(t["customer"].select(F.explode(F.array_compact(names)).alias("column")))


#: What a column's name ends in, and the predicate (with the key in it) and datatype that this suggests.
ENDS = (
    ("_lat", "'geo:lat'", "'xsd:decimal'"),
    ("_longitude", "'geo:long'", "'xsd:decimal'"),
    ("_trans_date_trans_time", "'ex:dateTime'", "'xsd:dateTime'"),
    ("_date", "'ex:date'", "'xsd:date'"),
    ("_unit_price", "'ex:c' || c_custkey || 'UnitPrice'", "'xsd:decimal'"),
    ("Year", "'ex:c' || c_custkey || 'Year'", "'xsd:integer'"),
    ("_flag", "'ex:c' || c_custkey || 'Flag'", "'xsd:boolean'"),
    ("_id", "'ex:identifier'", "'xsd:string'"),
    ("_genre", "NULL", "NULL"),
)


@query("SELECT 'c' || c_custkey || e.ending AS \"column\", CASE e.i " + " ".join(f"WHEN {i} THEN {x}" for i, (_, x, _) in enumerate(ENDS)) + " END AS predicate, e.datatype AS datatype FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{e}', {d})" for i, (e, _, d) in enumerate(ENDS)) + f") AS e(i, ending, datatype) ON c_custkey % {len(ENDS)} = e.i")
def fallback_predicates(t):
    ending = F.get(F.array(*(F.lit(e) for e, *_ in ENDS)), (F.col("c_custkey") % len(ENDS)).cast("int"))
    p, d = terms.fallback_columns(F.col("column"))
    return t["customer"].select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), ending).alias("column")).select("column", p.alias("predicate"), d.alias("datatype"))


@query("SELECT DISTINCT event_type, split_part(event_type, '_', 1) || 'TypeName' AS camel FROM events")
def camel_case(t):
    return t["events"].select("event_type").distinct().select("event_type", terms.camel_case(F.concat(F.substring_index("event_type", "_", 1), F.lit("_TYPE_name"))).alias("camel"))


@query(f"SELECT c_name, regexp_replace(c_name, '[^a-zA-Z0-9_]', '_', 'g') AS clean, 'kg:Customer/' || c_custkey AS curie, CAST(c_custkey AS VARCHAR) AS tail, CAST(c_custkey AS VARCHAR) AS row_id FROM customer")
def names_and_tails(t):
    u = F.concat(F.lit(KG + "Customer/"), F.col("c_custkey").cast("string"))
    made = F.concat(F.lit(KG + "x#Customer_"), F.col("c_custkey").cast("string"))
    return t["customer"].select("c_name", terms.sanitized(F.col("c_name")).alias("clean"), compact_column(u, {"kg": KG, "t": "http://kg.t"}).alias("curie"), terms.uri_tail(u).alias("tail"), terms.row_id(made).alias("row_id"))


HOSTS = ("https://data{}.acme.com/kg/", "http://www.my-kg{}.org/", "example{}-kg.net", "http://9x{}.org")


@query("SELECT replace((" + str(list(HOSTS)) + ")[c_custkey % 4 + 1], '{}', CAST(c_custkey AS VARCHAR)) AS uri, replace((['data{}', 'mykg{}', 'example{}kg', 'base'])[c_custkey % 4 + 1], '{}', CAST(c_custkey AS VARCHAR)) AS prefix FROM customer")
def host_prefixes(t):
    form = F.get(F.array(*map(F.lit, HOSTS)), (F.col("c_custkey") % 4).cast("int"))
    uris = t["customer"].select(F.replace(form, F.lit("{}"), F.col("c_custkey").cast("string")).alias("uri"))
    return uris.select("uri", terms.host_label(F.col("uri")).alias("prefix"))


TEMPLATES = ("kg:Film/$(c#)", "ex:A/$(x#)/$(y)~iri", "ex:B_{c}_$(d#)/Metadata")


@query("SELECT replace((" + str(list(TEMPLATES)) + ")[o_orderkey % 3 + 1], '#', CAST(o_orderkey AS VARCHAR)) AS template, replace((['c#', 'x#,y', 'd#'])[o_orderkey % 3 + 1], '#', CAST(o_orderkey AS VARCHAR)) AS refs, (['Film', 'A', 'B_{c}_/Metadata'])[o_orderkey % 3 + 1] AS base FROM orders")
def template_functions(t):
    form = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("o_orderkey") % 3).cast("int"))
    rows = t["orders"].select(F.replace(form, F.lit("#"), F.col("o_orderkey").cast("string")).alias("template"))
    return rows.select("template", F.array_join(terms.column_refs(F.col("template")), ",").alias("refs"), terms.subject_base(F.col("template")).alias("base"))


@query("SELECT p_name, replace(p_name, ' ', '%20') AS safe FROM part")
def iri_safe_encoding(t):
    return t["part"].select("p_name", terms.iri_safe(F.col("p_name")).alias("safe"))


@query()
def match_columns_to_properties(t):
    onto = read_ontology("@prefix kg: <http://kg.test/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . kg:Part a owl:Class . kg:partName a owl:DatatypeProperty ; rdfs:label \"name\" ; rdfs:domain kg:Part . kg:brand a owl:DatatypeProperty ; rdfs:domain kg:Part . kg:retailPrice a owl:DatatypeProperty . kg:madeBy a owl:ObjectProperty .")
    props = t.spark.createDataFrame([(i, p.uri, p.kind, p.label, p.domain, p.range) for i, p in enumerate(onto.properties)], "ord int, uri string, kind string, label string, domain string, range string")
    cols = t.spark.createDataFrame(list(enumerate(t["part"].columns)), "ordinal int, column string")
    return match_columns(cols, props)


# Checks of mapping documents: a mapping for each customer, whose class is its nation, and an entry for each of its orders


def numbered(head: str, column: str, tail: str = ""):
    return F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail))


def mappings(t):
    return t["customer"].select(numbered("C", "c_custkey").alias("name"), F.concat("c_mktsegment", F.lit(".csv~csv")).alias("source"), numbered("kg:Customer", "c_custkey", "/$(id)").alias("subject_template"), numbered("kg:Nation", "c_nationkey").alias("class"))


def entries(t):
    text = F.lit(None).cast("string")
    types = t["customer"].select(numbered("C", "c_custkey").alias("mapping"), F.lit(-1).cast("long").alias("ord"), F.lit("a").alias("predicate"), numbered("kg:Nation", "c_nationkey").alias("object_template"), F.lit("type").alias("kind"), text.alias("datatype"), F.array().cast("array<string>").alias("columns"))
    day = F.date_format("o_orderdate", "MM-dd")
    literals = t["orders"].select(numbered("C", "o_custkey").alias("mapping"), F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("n"), (F.col("o_orderkey") % 7).cast("string"), F.lit(":"), F.lower("o_orderstatus")).alias("predicate"), F.concat(F.lit("$("), day, F.lit(")")).alias("object_template"), F.lit("literal").alias("kind"), text.alias("datatype"), F.array(day).alias("columns"))
    return types.unionByName(literals)


ENTRY = "'n' || (o_orderkey % 7) || ':' || lower(o_orderstatus)"
DAY = "strftime(o_orderdate, '%m-%d')"


@query("SELECT DISTINCT 'n' || (o_orderkey % 7) AS prefix FROM orders WHERE o_orderkey % 7 NOT IN (SELECT r_regionkey FROM region)")
def check_prefix_completeness(t):
    declared = t["region"].select(numbered("n", "r_regionkey").alias("prefix")).unionByName(t.spark.createDataFrame([("kg",)], "prefix string"))
    return checks.missing_prefixes(entries(t), declared)


@query(f"SELECT 'C' || o_custkey AS mapping, {ENTRY} AS predicate, CAST(count(DISTINCT {DAY}) AS INTEGER) AS n_columns, string_agg(DISTINCT {DAY}, ',' ORDER BY {DAY}) AS columns FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) > 1 AND count(DISTINCT {DAY}) > 1")
def check_duplicate_predicates(t):
    return checks.duplicate_predicates(entries(t))


@query(f"SELECT {ENTRY} AS predicate, {DAY} AS \"column\", count(DISTINCT o_custkey) AS n_mappings FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) > 1 AND count(DISTINCT coalesce(c_nationkey, -1)) < count(DISTINCT o_custkey)")
def check_redundancy(t):
    return checks.redundancies(entries(t))


@query("SELECT 'C' || c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0) UNION ALL SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderkey % 3 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer))")
def check_islands(t):
    """Urgent orders are mappings as well; two in three link to their customer, by the customer's subject or by the mapping's name."""
    urgent = t["orders"].where("o_orderpriority = '1-URGENT'")
    orders = urgent.select(numbered("O", "o_orderkey").alias("name"), F.lit("orders.csv~csv").alias("source"), numbered("kg:Order", "o_orderkey", "/$(id)").alias("subject_template"), F.lit(None).cast("string").alias("class"))
    by_name = F.col("o_orderkey") % 3 == 1
    links = urgent.where("o_orderkey % 3 <> 0").select(numbered("O", "o_orderkey").alias("mapping"), F.when(by_name, numbered("C", "o_custkey")).otherwise(numbered("kg:Customer", "o_custkey", "/$(c)")).alias("object_template"), F.when(by_name, "join").otherwise("iri").alias("kind"))
    return checks.islands(mappings(t).unionByName(orders), links)


@query("SELECT 'p' || p_partkey AS \"column\" FROM part WHERE p_size NOT IN (1, 2) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE (l_returnflag = 'R' AND l_linenumber = 6) OR (l_returnflag = 'A' AND l_linenumber = 7))")
def check_column_coverage(t):
    """A column for each part; the lines of orders take some as values and some as subjects."""
    cols = t["part"].select(numbered("p", "p_partkey").alias("column"), (F.col("p_size") == 1).alias("is_empty"), (F.col("p_size") == 2).alias("is_conflict"))
    po = t["lineitem"].where("l_returnflag = 'R' AND l_linenumber = 6").select(F.array(numbered("p", "l_partkey")).alias("columns"))
    subjects = t["lineitem"].where("l_returnflag = 'A' AND l_linenumber = 7").select(numbered("kg:L/$(p", "l_partkey", ")").alias("subject_template"))
    return checks.uncovered_columns(cols, subjects, po)


@query("SELECT 'C' || c_custkey AS mapping, 'kg:Nation' || c_nationkey AS class FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def check_class_validity(t):
    known = t["nation"].where("n_regionkey <> 2").select(numbered("kg:Nation", "n_nationkey").alias("class"))
    return checks.invalid_classes(entries(t), known).select("mapping", "class")


@query(f"SELECT 'C' || o_custkey AS mapping, string_agg(DISTINCT {DAY}, ',' ORDER BY {DAY}) AS columns FROM orders GROUP BY 1")
def mapping_distribution(t):
    return checks.column_distribution(entries(t))


# Shapes


def shapes(t, *rows):
    return t.spark.createDataFrame(list(rows), shacl.SHAPE)


@query(f"SELECT 'NodeKindConstraintComponent' AS component, {C} AS focus, '{KG}segment' AS path, c_mktsegment AS value FROM customer")
def shacl_node_kind(t):
    s = shapes(t, ("n", "property", KG + "Customer", None, KG + "segment", "IRI", None, None, None), ("k", "node", KG + "Customer", None, None, "IRI", None, None, None))
    return shacl.validate(graph(t, CUSTOMERS, apart=True), s).select("component", "focus", "path", "value")


@query(f"SELECT {P} AS focus, CAST(p_size AS VARCHAR) AS value FROM part")
def shacl_datatype(t):
    s = shapes(t, ("d", "property", KG + "Part", None, KG + "size", "Literal", None, XSD + "decimal", None), ("e", "property", KG + "Part", None, KG + "size", "Literal", None, XSD + "integer", None))
    return shacl.validate(graph(t, PARTS, apart=True), s).select("focus", "value")


@query(f"SELECT {O} AS focus, {iri('Customer', 'o_custkey')} AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def shacl_class(t):
    # Customers have their segment as class.
    s = shapes(t, ("c", "property", KG + "Order", None, KG + "placedBy", None, KG + "BUILDING", None, None))
    return store(t).validate(s).select("focus", "value")


@query(f"SELECT {O} AS focus, o_orderpriority AS value FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-')")
def shacl_pattern(t):
    s = shapes(t, ("p", "property", KG + "Order", None, KG + "priority", None, None, None, "^[12]-"))
    return store(t).validate(s).select("focus", "value")


@query(f"SELECT {C} AS focus, '{KG}' || c_mktsegment AS type FROM customer")
def shacl_subclass(t):
    # A customer's class is its segment, two levels below the class of the shape.
    levels = "  SegmentMapping:\n    sources: [[customer~parquet]]\n    s: kg:$(c_mktsegment)\n    po:\n      - [rdfs:subClassOf, kg:Customer~iri]\n  ClassMapping:\n    sources: [[region~parquet]]\n    s: kg:Customer\n    po:\n      - [rdfs:subClassOf, kg:Party~iri]\n"
    g = graph(t, CUSTOMERS.replace("[a, kg:Customer]", "[a, kg:$(c_mktsegment)~iri]"), "\n" + levels, apart=True)
    bad = shacl.validate(g, shapes(t, ("k", "node", KG + "Party", None, None, "Literal", None, None, None)))
    return bad.select("focus").join(g.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("focus"), F.col("o").alias("type")), "focus")


@query("SELECT CAST(count(*) + count(*) FILTER (n_regionkey % 2 = 0) AS INTEGER) AS n_shapes, CAST(count(*) FILTER (n_regionkey % 2 <> 0) AS INTEGER) AS n_removed FROM nation")
def shacl_path_missing_sanitize(t):
    """A node shape for each nation, with a property shape that has a path in every other region. Shapes are metadata."""
    from trellis.sources.turtle import parse_turtle

    shape = "<http://x/N{0}> a sh:NodeShape ; sh:targetClass <http://x/C{0}> ; sh:property <http://x/p{0}> . <http://x/p{0}> a sh:PropertyShape ; sh:datatype <http://x/d>{1} ."
    text = [shape.format(r.n_nationkey, "" if r.n_regionkey % 2 else " ; sh:path <http://x/q>") for r in t["nation"].select("n_nationkey", "n_regionkey").collect()]
    clean, n = shacl.sanitize(parse_turtle("\n".join(["@prefix sh: <http://www.w3.org/ns/shacl#> .", *text]))[0])
    return t.spark.createDataFrame([(len(shacl.shape_rows(clean)), n)], "n_shapes int, n_removed int")


@query(f"SELECT 'PatternConstraintComponent' AS component, '{KG}priority' AS path, count(*) AS n, min(s) AS first FROM (SELECT {O} AS s FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-')) HAVING count(*) > 0")
def shacl_group_violations(t):
    s = shapes(t, ("p", "property", KG + "Order", None, KG + "priority", None, None, None, "^[12]-"))
    return shacl.grouped(store(t).validate(s)).select("component", "path", "n", F.col("examples")[0].alias("first"))


@query("SELECT substr(md5(string_agg(x, '|' ORDER BY x)), 1, 12) AS fingerprint FROM (SELECT DISTINCT event_type AS x FROM events)")
def shacl_fingerprint(t):
    return shacl.fingerprint(t["events"].select(F.col("event_type").alias("summary")).distinct())


@query("SELECT 0 AS n")
def shacl_structural(t):
    return shacl.validate(graph(t, CUSTOMERS, apart=True), shacl.structural_shapes(t.spark)).agg(F.count("*").cast("int").alias("n"))


# The triple store


@query(f"SELECT '{RDF_TYPE}' AS p, CAST((SELECT count(DISTINCT o_orderkey) FROM orders) + 2 * (SELECT count(DISTINCT c_custkey) FROM customer) + (SELECT count(DISTINCT n_nationkey) FROM nation) + (SELECT count(DISTINCT r_regionkey) FROM region) + (SELECT count(DISTINCT p_partkey) FROM part) AS BIGINT) AS n UNION ALL SELECT '{KG}placedBy', count(DISTINCT (o_orderkey, o_custkey)) FROM orders UNION ALL SELECT '{KG}within', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def store_counts(t):
    """What orders joins, counted again from the stored triples."""
    g = store(t)
    rows = g.triples.where(F.col("p").isin(RDF_TYPE, KG + "placedBy", KG + "within")).groupBy("p").agg(F.count("*").alias("n"))
    kept = t.spark.createDataFrame(list(g.counts.items()), "p string, n long")
    return rows.join(F.broadcast(kept), ["p", "n"]).select("p", "n")


@query(f"SELECT {O} AS o, {C} AS c, c_mktsegment AS x, n_name AS l FROM {JOINED} JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def store_star(t):
    """A star around orders, which meets in its buckets, and a chain from it."""
    return store(t).run('SELECT ?o ?c ?x ?l WHERE { ?o a kg:Order ; kg:priority "1-URGENT" ; kg:status "F" ; kg:placedBy ?c . ?c kg:segment ?x ; kg:nation/kg:label ?l }', {"kg": KG})


# Scores: the gold graph spells the customers' IRIs otherwise and lacks a segment


def fewer(t):
    return graph(Tables(t.spark, t.folder) | {"customer": t["customer"].where("c_mktsegment <> 'MACHINERY'")}, CUSTOMERS)


def sides(t):
    gen = graph(t, CUSTOMERS)
    t["customer"] = t["customer"].where("c_mktsegment <> 'MACHINERY'")
    return gen, graph(t, CUSTOMERS.replace("kg:Customer/$(c_custkey)", "kg:Customer_$(c_custkey)"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS \"row\", '{KG}segment' AS p, 'lit' AS kind, c_mktsegment AS o FROM customer UNION SELECT CAST(c_custkey AS VARCHAR), '{KG}nation', 'iri', CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT CAST(c_custkey AS VARCHAR), '{KG}name', 'lit', c_name FROM customer UNION SELECT CAST(c_custkey AS VARCHAR), '{RDF_TYPE}', 'iri', 'Customer' FROM customer")
def normalize_triples(t):
    return quality.normalized(graph(t, CUSTOMERS))


@query("SELECT 4 * tp AS norm_triple_tp, 4 * fp AS norm_triple_fp, 0 AS norm_triple_fn, round(tp / (tp + fp), 4) AS norm_triple_precision, 1.0::DOUBLE AS norm_triple_recall, round(2 * (tp / (tp + fp)) / (1 + tp / (tp + fp)), 4) AS norm_triple_f1 FROM (SELECT (count(*) FILTER (c_mktsegment <> 'MACHINERY'))::DOUBLE AS tp, (count(*) FILTER (c_mktsegment = 'MACHINERY'))::DOUBLE AS fp FROM customer)")
def l2_triple_prf(t):
    gen, gold = sides(t)
    return quality.compare_sets(quality.normalized(gen), quality.normalized(gold), "norm_triple").select(*(F.col(f"norm_triple_{k}").cast("double").alias(f"norm_triple_{k}") if k in ("tp", "fp") else F.col(f"norm_triple_{k}") for k in ("tp", "fp", "fn", "precision", "recall", "f1")))


@query("SELECT 4 AS predicate_tp, 0 AS predicate_fp, 0 AS predicate_fn, 1.0::DOUBLE AS predicate_f1")
def l2_predicate_prf(t):
    gen, gold = sides(t)
    return quality.compare_sets(quality.predicates(gen), quality.predicates(gold), "predicate").select("predicate_tp", "predicate_fp", "predicate_fn", "predicate_f1")


@query("SELECT 1 AS class_tp, 1 AS class_fp, 0 AS class_fn, 0.5::DOUBLE AS class_precision, 1.0::DOUBLE AS class_recall, 0.6667::DOUBLE AS class_f1")
def l2_class_prf(t):
    return quality.compare_sets(quality.classes(graph(t, CUSTOMERS, PARTS)), quality.classes(graph(t, CUSTOMERS)), "class")


@query(f"SELECT '{KG}segment' AS p, 'lit' AS gen_kinds, 'iri' AS gold_kinds")
def l2_type_mismatch(t):
    gen = graph(t, CUSTOMERS)
    return quality.type_mismatches(gen, gen.withColumn("o_kind", F.when(F.col("p") == KG + "segment", "iri").otherwise(F.col("o_kind"))))


@query("SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS \"column\", unnest([FALSE, TRUE, FALSE, FALSE, TRUE]) AS found")
def l3_coverage_value(t):
    return quality.value_coverage(t["customer"], graph(t, CUSTOMERS), ["c_custkey"]).select("column", "found")


@query("SELECT count(*) AS cq_total, count(*) FILTER (o_orderstatus = 'F') AS cq_passed, count(*) FILTER (o_orderstatus = 'O') AS cq_failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS cq_error, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS cq_coverage FROM orders")
def l4_cq_coverage(t):
    """An answer for each order; neither true nor false where the status is neither."""
    answer = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return quality.question_coverage(t["orders"].select(answer.alias("passed")))


@query("SELECT count(*) FILTER (c_mktsegment <> 'MACHINERY') AS classes_tp, count(*) FILTER (c_mktsegment = 'MACHINERY') AS classes_fp, 0 AS classes_fn FROM customer")
def multiset_class_f1(t):
    gen = graph(t, CUSTOMERS)
    gold = fewer(t)
    return quality.compare_bags(gen.where(F.col("p") == RDF_TYPE).select("o"), gold.where(F.col("p") == RDF_TYPE).select("o"), "classes").select("classes_tp", "classes_fp", "classes_fn")


@query("SELECT 4 * count(*) FILTER (c_mktsegment <> 'MACHINERY') AS predicates_tp, 4 * count(*) FILTER (c_mktsegment = 'MACHINERY') AS predicates_fp FROM customer")
def multiset_predicate_f1(t):
    gen = graph(t, CUSTOMERS)
    return quality.compare_bags(gen.select("p"), fewer(t).select("p"), "predicates").select("predicates_tp", "predicates_fp")


@query("SELECT count(*) FILTER (c_mktsegment <> 'MACHINERY') AS subjects_tp, count(*) FILTER (c_mktsegment = 'MACHINERY') AS subjects_fp, 0 AS subjects_fn FROM customer")
def subject_fuzzy_f1(t):
    gen = graph(t, CUSTOMERS)
    other = fewer(t).withColumn("s", F.concat(F.regexp_replace("s", "kg.test", "other.test"), F.lit("/")))
    return quality.compare_sets(quality.subject_ids(gen), quality.subject_ids(other), "subjects").select("subjects_tp", "subjects_fp", "subjects_fn")


@query("WITH a AS (SELECT DISTINCT k, v FROM (SELECT unnest([1, 2, 3, 4]) AS k, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, 'x']) AS v FROM customer)), b AS (SELECT DISTINCT k, v FROM (SELECT unnest([1, 2, 3, 4]) AS k, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, 'x']) AS v FROM customer WHERE c_mktsegment <> 'MACHINERY')) SELECT (SELECT count(*) FROM b) AS po_tp, (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS po_fp, 0 AS po_fn")
def distinct_po_f1(t):
    gen = graph(t, CUSTOMERS)
    gold = fewer(t)
    return quality.compare_sets(gen.select("p", "o").distinct(), gold.select("p", "o").distinct(), "po").select("po_tp", "po_fp", "po_fn")


# Logs


@query("SELECT o_orderpriority AS dataset, o_orderstatus AS llm, count(*) AS n_runs, round_even(avg(o_totalprice), 2) AS score_mean, round_even(stddev_samp(o_totalprice), 2) AS score_std, min(o_totalprice) AS score_min, max(o_totalprice) AS score_max, sum(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ok_sum FROM orders GROUP BY 1, 2")
def experiment_summary(t):
    logs = t["orders"].select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("llm"), F.col("o_totalprice").alias("score"), (F.col("o_totalprice") > 200000).alias("ok"))
    return experiments.summarise(logs, ["dataset", "llm"], ["ok"], ["score"], 2).select("dataset", "llm", "n_runs", "score_mean", "score_std", "score_min", "score_max", "ok_sum")


@query("SELECT r_name AS name, r_regionkey AS region, CAST(NULL AS INTEGER) AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
def experiment_union_schema(t):
    return experiments.union_all([t["region"].select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), t["nation"].select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))])


@query(" UNION ALL ".join(f"SELECT '{p}' AS p, count({c}) AS n FROM part" for p, c in ((RDF_TYPE, "p_partkey"), (KG + "brand", "p_brand"), (KG + "size", "p_size"), *((f"http://example.org/p{c}", f"p_{c.lower()}") for c in ("Partkey", "Name", "Type", "Retailprice")))))
def pipeline_end_to_end(t):
    from trellis.pipeline import build_graph

    onto = "@prefix kg: <http://kg.test/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . kg:Part a owl:Class . kg:brand a owl:DatatypeProperty ; rdfs:domain kg:Part ; rdfs:range xsd:string . kg:size a owl:DatatypeProperty ; rdfs:domain kg:Part ; rdfs:range xsd:integer ."
    return build_graph(t.spark, t["part"], "part.csv", onto).triples.groupBy("p").agg(F.count("*").alias("n"))


@query(f"SELECT '{RDF_TYPE}' AS p, '{KG}Order' AS o, count(*) AS n FROM orders UNION ALL SELECT '{KG}status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT '{KG}priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def question_routing(t):
    """A document without a class and with the priority under a name of its own; the questions that fail put both right."""
    from trellis.pipeline import build_graph

    onto = f"@prefix kg: <{KG}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . kg:Order a owl:Class . kg:status a owl:DatatypeProperty ; rdfs:domain kg:Order . kg:priority a owl:DatatypeProperty ; rdfs:domain kg:Order ."
    asks = [(x, f"PREFIX kg: <{KG}> ASK {{ {x} }}") for x in ("?o a kg:Order", "?o kg:status ?x", "?o a kg:Order ; kg:priority ?x", '?o kg:priority "1-URGENT"')]
    doc = HEAD + "  OrderMapping:\n    sources: [[orders.csv~csv]]\n    s: kg:Order/$(o_orderkey)\n    po:\n      - [kg:status, $(o_orderstatus)]\n"
    run = build_graph(t.spark, t["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority"), "orders.csv", onto, doc, asks=asks, validate=False)
    return run.triples.groupBy("p", "o").agg(F.count("*").alias("n"))


@query(f"SELECT '{KG}Event/' || event_id AS s, '{KG}kind' AS p, event_type AS o FROM events")
def stream_materialize(t):
    """Triples of a stream of files, each row of which comes twice, in different batches: state over the batches makes them a set."""
    from trellis.streaming.materialize import start

    doc = parse(HEAD + "\n  E:\n    sources: [[events~parquet]]\n    s: kg:Event/$(event_id)\n    po:\n      - [kg:kind, $(event_type)]\n")
    rows, folder = t["events"].withColumn("ts", F.col("ts").cast("timestamp")), shared_folder(t.spark)
    rows.unionByName(rows).repartition(4).write.parquet(f"{folder}/in")
    arriving = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start(doc, "events", arriving, "ts", f"{folder}/out", f"{folder}/state", delay="36500 days").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("s", "p", "o")
