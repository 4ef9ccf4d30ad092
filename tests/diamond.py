"""A small film table, its ontology, mapping, gold graph and questions: values that published results are known for."""

#: The table.
CSV = """movie_id,primaryTitle,originalTitle,startYear,runtimeMinutes,genres,isAdult,titleType,person_id,primaryName,category,ordering,birthYear,deathYear
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0000018,Kirk Douglas,actor,1,1916,2020
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0000002,Lauren Bacall,actress,2,1924,2014
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0000101,Dan Aykroyd,actor,3,1952,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0021607,Corbin Allred,actor,4,1979,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0038875,John Asher,director,5,1971,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0441631,Allan Aaron Katz,writer,6,,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm4500812,Patricia Green,producer,7,,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0006107,Joel Goldsmith,composer,8,1957,2012
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0254580,Paul Elliott,cinematographer,9,,
tt0167423,Diamonds,Diamonds,1999,91,"Comedy, Mystery",0,movie,nm0002706,David L. Bertman,editor,10,,
"""

#: The document that the published graph was made by.
MAPPING = """
prefixes:
  ex: "http://example.org/"
  dbo: "http://dbpedia.org/ontology/"
  xsd: "http://www.w3.org/2001/XMLSchema#"
  mykg: "http://mykg.org/resource/"

mappings:
  FilmMapping:
    sources:
      - [data/movie_data.csv~csv]
    s: mykg:Film/$(movie_id)
    po:
      - [a, dbo:Film]
      - [dbo:title, $(primaryTitle), xsd:string]
      - [dbo:originalTitle, $(originalTitle), xsd:string]
      - [dbo:startYear, $(startYear), xsd:gYear]
      - [dbo:runtime, $(runtimeMinutes), xsd:integer]
      - [dbo:genre, $(genres), xsd:string]
      - [dbo:isAdult, $(isAdult)]
      - [dbo:titleType, $(titleType), xsd:string]
      - [ex:ordering, $(ordering), xsd:string]
      - [dbo:starring, mykg:Person/$(person_id)~iri]

  PersonMapping:
    sources:
      - [data/movie_data.csv~csv]
    s: mykg:Person/$(person_id)
    po:
      - [a, dbo:Person]
      - [dbo:name, $(primaryName), xsd:string]
      - [dbo:profession, $(category), xsd:string]
      - [dbo:birthYear, $(birthYear), xsd:gYear]
      - [dbo:deathYear, $(deathYear), xsd:gYear]
"""

#: The published gold graph, as N-Triples.
GOLD = """\
<http://mykg.org/resource/nm0000002> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Actor> .
<http://mykg.org/resource/nm0000002> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0000002> <http://dbpedia.org/ontology/name> "Lauren Bacall" .
<http://mykg.org/resource/nm0000002> <http://dbpedia.org/ontology/birthYear> "1924"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0000002> <http://dbpedia.org/ontology/deathYear> "2014"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0000018> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Actor> .
<http://mykg.org/resource/nm0000018> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0000018> <http://dbpedia.org/ontology/name> "Kirk Douglas" .
<http://mykg.org/resource/nm0000018> <http://dbpedia.org/ontology/birthYear> "1916"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0000018> <http://dbpedia.org/ontology/deathYear> "2020"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0000101> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Actor> .
<http://mykg.org/resource/nm0000101> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0000101> <http://dbpedia.org/ontology/name> "Dan Aykroyd" .
<http://mykg.org/resource/nm0000101> <http://dbpedia.org/ontology/birthYear> "1952"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0002706> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0002706> <http://dbpedia.org/ontology/name> "David L. Bertman" .
<http://mykg.org/resource/nm0006107> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0006107> <http://dbpedia.org/ontology/name> "Joel Goldsmith" .
<http://mykg.org/resource/nm0006107> <http://dbpedia.org/ontology/birthYear> "1957"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0006107> <http://dbpedia.org/ontology/deathYear> "2012"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0021607> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Actor> .
<http://mykg.org/resource/nm0021607> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0021607> <http://dbpedia.org/ontology/name> "Corbin Allred" .
<http://mykg.org/resource/nm0021607> <http://dbpedia.org/ontology/birthYear> "1979"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0038875> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0038875> <http://dbpedia.org/ontology/name> "John Asher" .
<http://mykg.org/resource/nm0038875> <http://dbpedia.org/ontology/birthYear> "1971"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/nm0254580> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0254580> <http://dbpedia.org/ontology/name> "Paul Elliott" .
<http://mykg.org/resource/nm0441631> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm0441631> <http://dbpedia.org/ontology/name> "Allan Aaron Katz" .
<http://mykg.org/resource/nm4500812> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Person> .
<http://mykg.org/resource/nm4500812> <http://dbpedia.org/ontology/name> "Patricia Green" .
<http://mykg.org/resource/tt0167423> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/Film> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/Work/runtime> "91"^^<https://dbpedia.org/datatype/minute> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/genre> "Comedy" .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/genre> "Mystery" .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/originalTitle> "Diamonds" .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/title> "Diamonds" .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/startYear> "1999"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/composer> <http://mykg.org/resource/nm0006107> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/director> <http://mykg.org/resource/nm0038875> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/editing> <http://mykg.org/resource/nm0002706> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/producer> <http://mykg.org/resource/nm4500812> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/writer> <http://mykg.org/resource/nm0441631> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/starring> <http://mykg.org/resource/nm0000002> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/starring> <http://mykg.org/resource/nm0000018> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/starring> <http://mykg.org/resource/nm0000101> .
<http://mykg.org/resource/tt0167423> <http://dbpedia.org/ontology/starring> <http://mykg.org/resource/nm0021607> .
"""


def gold() -> str:
    """The 49 gold triples as N-Triples."""
    return GOLD


#: Prefixes, questions and their published answers.
PREFIXES = {"dbo": "http://dbpedia.org/ontology/", "ex": "http://example.org/", "mykg": "http://mykg.org/resource/"}
ASKS = [
    ("ASK { ?film a dbo:Film . }", True),
    ("ASK { ?film a dbo:Film ; dbo:runtime ?runtime . }", True),
    ('ASK { ?actor a dbo:Person ; dbo:profession "Actor" . ?film a dbo:Film ; dbo:title ?title . ?actor dbo:starring ?film . }', False),
    ("ASK { ?person a dbo:Person ; dbo:birthYear ?birthYear ; dbo:deathYear ?deathYear . }", True),
    ("ASK { ?film a dbo:Film ; dbo:originalTitle ?originalTitle . }", True),
    ("ASK { ?film a dbo:Film ; dbo:genre ?genre . }", True),
    ("ASK { ?film a dbo:Film ; ex:isAdult true . }", False),
    ("ASK { ?person a dbo:Person ; dbo:name ?name . }", True),
    ("ASK { ?film a dbo:Film ; dbo:startYear ?year . }", True),
    ('ASK { ?person a dbo:Person ; dbo:profession ?profession . FILTER(?profession = "actor" || ?profession = "director") }', True),
]
