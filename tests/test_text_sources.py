import pytest
from pyspark.sql import functions as F

from threadgraph.functions import scores as sc
from threadgraph.functions import text as tx
from threadgraph.operators import corpus as cp
from threadgraph.operators import joins as jn
from threadgraph.sources import articles as ar
from threadgraph.sources import ontology as on

PROMPT = "I need to build a healthcare system that tracks patient medications and sends alerts to family members"
GOOD = ("INSTRUCTION 1: Implement a patient medication tracking database using PostgreSQL with tables for patients and schedules.\n\n"
        "INSTRUCTION 2: Configure an automated alert system using an SMS API to notify family members when medications are missed.\n\n"
        "INSTRUCTION 3: Deploy the healthcare dashboard using a React frontend connected to a Flask backend with authentication.")
POOR = "INSTRUCTION 1: Think about some kind of thing.\n\nINSTRUCTION 2: Maybe try to do alerts somehow.\n\nINSTRUCTION 3: Make a solution that works."


def test_good_text_beats_poor(spark):
    df = spark.createDataFrame([("good", PROMPT, GOOD), ("poor", PROMPT, POOR)], "prompt_id string, prompt string, response string")
    r = {x["prompt_id"]: x for x in sc.score_texts(df, F.lit("healthcare")).collect()}
    for k in ("actionability", "domain_specificity", "technological_specificity", "user_focus", "overall"):
        assert r["good"][k] > r["poor"][k], k
    assert all(0 <= r["good"][k] <= 1.3 for k in ("actionability", "coherence", "domain_specificity", "technological_specificity"))


def test_scores_of_empty_and_single(spark):
    df = spark.createDataFrame([("e", "p", ""), ("s", "p q", "One sentence only.")], "prompt_id string, prompt string, response string")
    r = {x["prompt_id"]: x for x in sc.score_texts(df).collect()}
    assert r["e"]["actionability"] == r["e"]["coherence"] == r["e"]["understandability"] == 0.0
    f = {x["prompt_id"]: x for x in sc.logical_flow(df).collect()}
    assert f["s"]["logical_flow_score"] == 1.0


def test_cleaning(spark):
    one = lambda c, **k: spark.range(1).select(c).first()[0]
    assert one(tx.clean_text(F.lit("  Größe:\n 5 €, ok?! <b> "))) == "Größe 5 , ok?! b"
    assert one(tx.clean_label(F.lit("\u00a0a\n\tb  c "), True)) == "a b c"
    assert one(tx.short_label(F.lit("ns0__Is_implemented_by_data"))) == "→data"
    assert one(tx.format_doc_id(F.lit("document/2401.123v2"))) == "arXiv:2401.123 (v2)"
    assert one(tx.resolve_doc_url(F.lit("dev.to/x/y"))) == "https://dev.to/x/y"
    assert one(tx.resolve_doc_url(F.lit("document/2401.12345v3"))) == "https://arxiv.org/abs/2401.12345"
    assert one(F.array_join(tx.simple_entities(F.lit("Use the Flask api")), ",")) == "API,Flask,Use"
    assert one(tx.strip_iri_text(F.lit('<a rdf:resource="http://x.org/o#B"/> http://x.org/o#C'), ["http://y.org/"])) == '<a rdf:resource="B"/> http://x.org/o#C'


def test_sections_and_triples(spark):
    df = spark.createDataFrame([("1", "intro\n1. **Alpha:**\n - one\n - two\n2. **Beta:** - three")], "id string, text string")
    got = [(r["section"], r["title"], r["bullet"]) for r in tx.parse_summary_sections(df).orderBy("section", "bullet_no").collect()]
    assert got == [(1, "Alpha", "one"), (1, "Alpha", "two"), (2, "Beta", "three")]
    lines = spark.createDataFrame([("1", "1. (A, uses, B)\nno\n(bad, two)\n2. (C , has , D) tail")], "id string, text string")
    assert [(r[2], r[3], r[4]) for r in tx.parse_triple_lines(lines).orderBy("line_no").collect()] == [("A", "uses", "B"), ("C", "has", "D")]


def test_surrogate_ids_are_stable(spark):
    df = spark.range(1000).select(F.lit("g").alias("graph_id"), F.col("id").cast("string").alias("seq"))
    ids = [r[0] for r in df.select(tx.surrogate_id(F.col("graph_id"), F.col("seq"), "user")).collect()]
    assert len(set(ids)) == 1000 and all(i.startswith("user_") for i in ids)


def test_hand_lists_zip(spark):
    df = spark.createDataFrame([("g", ["healthcare", "AI", "x"], ["uses", "analyzes"], ["management", "analysis"])], "graph_id string, c array<string>, r array<string>, t array<string>")
    got = [(r["subject_label"], r["predicate"], r["object_label"]) for r in jn.zip_triples(df, "c", "r", "t").orderBy("pos").collect()]
    assert got == [("healthcare", "uses", "management"), ("AI", "analyzes", "analysis")]


def test_triples_of_all_relation_words(spark):
    text = "Old stone bridge was part of northern trade road. Is nothing. Walls were of of clay; is 12. The of the. Roof IS red tile"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a is b is c " * 3)], "doc_id long, text string")
    got = [tuple(r) for r in cp.extract_triples(docs, ["was", "were", "is", "of"]).orderBy("doc_id", "sentence_no", "match_no").collect() if r["doc_id"] < 4]
    assert got == [(1, 0, 0, "old stone bridge", "was", "part"), (1, 0, 1, "part", "of", "northern trade road"), (1, 4, 0, "roof", "is", "red tile")]
    rows = cp.extract_triples(docs.filter("doc_id = 4"), ["is"], stop=("x",)).orderBy("match_no").collect()
    assert [(r["subject"], r["object"]) for r in rows] == [("a", "b"), ("b", "c a"), ("c a", "b"), ("b", "c a"), ("c a", "b"), ("b", "c")]


def test_spelling_prefers_near_then_frequent(spark):
    known = spark.createDataFrame([("graph", 5), ("grape", 50), ("model", 9)], "word string, n long")
    unknown = spark.createDataFrame([("graphs",), ("grap",), ("modle",), ("zzzzzzz",)], "word string")
    assert {r["word"]: r["correction"] for r in cp.correct_spelling(unknown, known).collect()} == {"graphs": "graph", "grap": "grape", "modle": "model"}


def test_similar_words_share_contexts(spark):
    rows = [(i, "alpha beta common" if i % 2 else "gamma delta common") for i in range(200)]
    v = cp.context_vectors(spark.createDataFrame(rows, "doc_id long, text string"), dim=32).cache()
    got = {r["word"]: r["neighbour"] for r in cp.most_similar(spark.createDataFrame([("alpha",), ("gamma",)], "word string"), v, 1).collect()}
    assert got == {"alpha": "beta", "gamma": "delta"}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kw = spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id long, word string")
    hits = cp.search_by_keywords(kw, v, cp.document_vectors(docs, v, 32), 32, 10).collect()
    assert len(hits) == 10 and all(int(r["doc_id"]) % 2 for r in hits)


def test_entity_pairs_brute(spark):
    m = [("d", s) for s in (0, 3, 9, 10, 25)] + [("e", 4)]
    df = spark.createDataFrame(m, "doc_id string, start long")
    got = {(r["start1"], r["start2"]) for r in jn.entity_pairs(df, 7).collect()}
    assert got == {(a, b) for d, a in m for e, b in m if d == e and a != b and abs(a - b) <= 7}
    assert jn.entity_pairs(df, 0).count() == 0


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#">
  <owl:NamedIndividual rdf:about="http://x.org/o#A">
    <rdf:type rdf:resource="http://x.org/o#Tool"/>
    <uses rdf:resource="http://x.org/o#B"/>
    <uses rdf:resource="http://x.org/o#C"/>
  </owl:NamedIndividual>
  <owl:NamedIndividual rdf:about="http://x.org/o#B">
    <rdf:type rdf:resource="http://x.org/o#Tool"/>
    <note>plain text</note>
  </owl:NamedIndividual>
</rdf:RDF>
"""


def test_owl_scan(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    rdf = tx.strip_iri(on.scan_owl_xml(spark, str(tmp_path / "o.owl")), ["http://x.org/o#"])
    got = {(r["s"], r["p"], r["o"], r["o_kind"]) for r in rdf.collect()}
    assert got == {("A", "rdf:type", "Tool", "uri"), ("A", "uses", "B", "uri"), ("A", "uses", "C", "uri"), ("B", "rdf:type", "Tool", "uri"), ("B", "note", "plain text", "literal")}


def test_owl_children_of_all_kinds(spark, tmp_path):
    """Literals as written, attributes in either quotes, comments, CDATA, nested and empty children, several lines."""
    body = """<rdf:RDF><owl:NamedIndividual rdf:about="E"/><owl:NamedIndividual rdf:about='A&amp;1'>
 <lab xml:lang="en"\n rdf:datatype='d'> a &lt;b&gt; "c" </lab><lab>007</lab><lab>1.50</lab><!-- <lab>gone</lab> --><x:e/><x:e></x:e>
 <nest><lab>inner</lab></nest><raw><![CDATA[a < b]]></raw><two>first
second</two><own/><self rdf:resource=''/></owl:NamedIndividual>
<owl:NamedIndividual rdf:about="B" ><lab>b</lab><lab rdf:resource="u"/></owl:NamedIndividual></rdf:RDF>"""
    (tmp_path / "a.owl").write_text(body)
    (tmp_path / "b.owl").write_text("<rdf:RDF></rdf:RDF>")
    got = sorted((r["s"], r["p"], r["o"], r["o_kind"], r["datatype"], r["lang"]) for r in on.scan_owl_xml(spark, str(tmp_path)).collect())
    lit = lambda s, p, o: (s, p, o, "literal", None, None)
    want = [("A&1", "lab", 'a <b> "c"', "literal", "d", "en"), lit("A&1", "lab", "007"), lit("A&1", "lab", "1.50"), lit("A&1", "raw", "a < b"),
            ("A&1", "self", "", "uri", None, None), lit("A&1", "two", "first\nsecond"), lit("B", "lab", "b"), ("B", "lab", "u", "uri", None, None)]
    assert got == sorted(want)


def test_ontology_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("doc_id,sub,relation,obj\n1,a,uses,b\n1,b,has,c\n2,x,has,y\n")
    t = on.scan_ontology_csv(spark, str(tmp_path / "t.csv"))
    assert on.unique_topics(t).count() == 5
    assert cp.map_to_ontology(spark.createDataFrame([("a",)], "prompt_topic string"), t).count() == 2  # document 2 shares no concept with a


@pytest.mark.parametrize("cols,want", [(["description", "url"], ("description", "url")), (["Content", "Query"], ("Content", "Query")), (["id", "title", "my_url"], ("title", "my_url"))])
def test_column_rules(cols, want):
    m = ar.column_mapping(cols)
    assert (m["Topics"], m["URLs"]) == want


def test_stream_equals_batch(spark, tmp_path):
    from threadgraph.streaming.ingest import read_articles, stream_ingest_articles

    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        (src / f"{i}.csv").write_text("id,description,url,extra\n" + "".join(f'{j},"text, {i} {j}",http://x/{j},e\n' for j in range(10)))
    schema = "id string, description string, url string, extra string"
    from pyspark.sql.types import _parse_datatype_string as parse

    rows = read_articles(spark, str(src), parse(schema), files_per_trigger=1).withColumn("index", F.lit("inv_1"))
    stream_ingest_articles(rows, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    batch = ar.extra_fields_map(ar.normalize_articles(ar.scan_articles(spark, {"inv_1": str(src)})))
    key = lambda df: sorted((r["Topics"], r["URLs"], tuple(sorted(r["extra"].items()))) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_job_stream_expires_from_creation(spark, tmp_path):
    from threadgraph.streaming.jobs import job_state, job_state_stream

    schema = "job_id long, ts timestamp, seq long, status string, progress double"
    src = tmp_path / "ev"
    first = spark.sql("select 1L job_id, timestamp'2024-01-01 00:00:00' ts, 1L seq, 'queued' status, 0.0D progress union all select 1L, timestamp'2024-01-01 01:00:00', 2L, 'running', 0.5D union all select 2L, timestamp'2024-01-01 01:30:00', 3L, 'queued', 0.0D")
    later = spark.sql("select 2L job_id, timestamp'2024-01-01 04:50:00' ts, 4L seq, 'done' status, 1.0D progress")
    first.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = job_state_stream(stream).writeStream.format("memory").queryName("jobs_out").outputMode("update").start()
    q.processAllAvailable()
    later.coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    rows = [(r["job_id"], r["status"], r["expired"]) for r in spark.table("jobs_out").collect()]
    assert (1, "running", False) in rows and (2, "queued", False) in rows and (2, "done", False) in rows
    assert (1, "running", True) in rows  # four hours after creation, not after the last update
    batch = {r["job_id"]: (r["status"], r["alive"]) for r in job_state(first.unionByName(later)).collect()}
    assert batch == {1: ("running", False), 2: ("done", True)}
