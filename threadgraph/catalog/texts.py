"""Text functions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgraph import fixtures as fx
from threadgraph.catalog import query
from threadgraph.catalog.views import RND, with_views
from threadgraph.functions import lexicons as lex
from threadgraph.functions import scores as sc
from threadgraph.functions import text as tx
from threadgraph.operators.common import rnd

W = r"[\p{L}\p{N}_]"
q = lambda s: "'" + s.replace("'", "''") + "'"
cnt = lambda low, terms: "(" + "+".join(f"contains({low},{q(t)})::INT" for t in terms) + ")"
occ = lambda low, terms: "(" + "+".join(f"((length({low})-length(replace({low},{q(t)},'')))//{len(t)})" for t in terms) + ")"
lst = lambda terms: "[" + ",".join(q(t) for t in terms) + "]"
toks = lambda t: rf"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x<>'')"
sents = lambda t: rf"list_filter(string_split(regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)), lambda x: x<>'')"
ntok = lambda t: rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
cos = lambda a, b: f"(CASE WHEN len({a})>0 AND len({b})>0 THEN len(list_intersect({a},{b}))/sqrt((len(list_distinct({a}))*len(list_distinct({b})))::DOUBLE) ELSE 0.0 END)"
wsplit = lambda t: rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x<>'')"
share = lambda c, n: f"least({c}/{n}.0::DOUBLE,1.0)"


def doc(spark, sf):
    return fx.table(spark, sf, "documents")


@query("p1_clean_text", rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s.,!?-]', '', 'g')) AS clean FROM documents")
def clean_text_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("p2_clean_label", "SELECT doc_id, trim(translate(text, chr(160)||chr(10)||chr(9), '   ')) AS plain, regexp_replace(trim(translate(text, chr(160)||chr(10)||chr(9), '   ')), ' +', ' ', 'g') AS collapsed FROM documents")
def clean_label_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.clean_label(F.col("text")).alias("plain"), tx.clean_label(F.col("text"), True).alias("collapsed"))


@query("p3_validate_required", rf"""SELECT doc_id, CASE WHEN e IS NULL THEN 'ok' ELSE 'error' END AS status, e AS error FROM (SELECT doc_id, CASE WHEN text='' THEN 'Missing required field: text_input' WHEN coalesce(quality::VARCHAR,'')='' THEN 'Missing required field: approach'
 WHEN trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,!?-]', '', 'g'))='' THEN 'Text input is empty after cleaning' END AS e FROM documents LEFT JOIN labels USING (doc_id))""")
def validate_q(spark, sf):
    d = doc(spark, sf).join(fx.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.col("text").alias("text_input"), F.col("quality").cast("string").alias("approach"))
    return tx.validate_required(d, ["text_input", "approach"]).select("doc_id", "status", "error")


@query("p4_has_numbers", r"SELECT doc_id, regexp_matches(text, '\d') AS has_numbers FROM documents")
def numbers_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.has_numbers(F.col("text")).alias("has_numbers"))


@query("p6_option_terms", "SELECT p_partkey, array_to_string(list_transform(list_concat([p_name], list_filter([CASE WHEN p_size%2=0 THEN 'deep learning' END, CASE p_type WHEN 'ECONOMY' THEN 'classifier' WHEN 'STANDARD' THEN 'regression' END], lambda x: x IS NOT NULL)), lambda x: replace(x,'_',' ')), '|') AS concepts FROM part")
def options_q(spark, sf):
    approach = F.when(F.col("p_size") % 2 == 0, "Deep Learning").otherwise("None")
    op = F.when(F.col("p_type") == "ECONOMY", "Classification_nonlinear").when(F.col("p_type") == "STANDARD", "Regression").otherwise("None")
    return fx.table(spark, sf, "part").select("p_partkey", F.array_join(tx.option_terms(F.array("p_name"), approach, op), "|").alias("concepts"))


@query("p7_filter_keywords", "SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(lower(p_name),' ')) AS word FROM part WHERE lower(p_name) NOT IN ('our','we')) WHERE word IN (SELECT unnest(string_split(lower(p_name),' ')) FROM part WHERE p_size<5)")
def keywords_q(spark, sf):
    p = fx.table(spark, sf, "part")
    vocab = p.filter("p_size < 5").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return tx.filter_keywords(p.select("p_partkey", F.col("p_name").alias("phrase")), vocab)


@query("p8_truncate", "SELECT doc_id, CASE WHEN length(text)>1000 THEN substr(text,1,1000)||'...' ELSE text END AS short FROM documents")
def truncate_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.truncate(F.col("text"), 1000).alias("short"))


@query("p9_drop_generic", with_views("SELECT seq FROM triples WHERE lower(subject_label) NOT IN ('nation_1','nation_2') AND lower(object_label) NOT IN ('nation_1','nation_2')"))
def generic_q(spark, sf):
    from threadgraph.operators.corpus import drop_generic

    return drop_generic(fx.triples(spark, sf), ["nation_1", "NATION_2"]).select("seq")


@query("p13_short_label", with_views("SELECT id, CASE WHEN length(l)>15 THEN substr(l,1,13)||'...' ELSE l END AS short FROM (SELECT id, replace(regexp_replace('ns0__Is_implemented_by_'||label, '^ns0__', ''), 'Is_implemented_by_', '→') AS l FROM nodes)"))
def short_q(spark, sf):
    from threadgraph.catalog.graphs import _graph

    return _graph(spark, sf)[0].select("id", tx.short_label(F.concat(F.lit("ns0__Is_implemented_by_"), "label")).alias("short"))


@query("p14_highlight_tokens", "SELECT item_id, generate_subscripts(t,1)-1 AS token_no, unnest(t) AS token, unnest(list_transform(t, lambda x: contains(lower(x),'tion') OR contains(lower(x),'the'))) AS highlight FROM (SELECT item_id, string_split(text,' ') AS t FROM benchmark)")
def highlight_q(spark, sf):
    return tx.highlight_tokens(fx.table(spark, sf, "benchmark"), "text", ["tion", "The"])


TRIPLE_TEXT = "string_agg('1. ('||c_name||', lives in,'||c_mktsegment||'), note', chr(10) ORDER BY c_custkey)||chr(10)||'no triple here (a, b)'"


@query("p16_parse_triple_lines", "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS line_no, c_name AS subject_label, 'lives in' AS predicate, c_mktsegment AS object_label FROM customer")
def parse_q(spark, sf):
    c = fx.table(spark, sf, "customer").withColumn("line", F.concat(F.lit("1. ("), "c_name", F.lit(", lives in,"), "c_mktsegment", F.lit("), note")))
    text = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return tx.parse_triple_lines(text.select("c_nationkey", F.concat("t", F.lit("\nno triple here (a, b)")).alias("text")))


@query("p17_simple_entities", with_views(rf"SELECT prompt_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(prompt, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), list_filter({lst(lex.NAMED_TERMS)}, lambda x: contains(lower(prompt), lower(x)))))), '|') AS entities FROM pairs"))
def entities_q(spark, sf):
    return fx.prompt_pairs(spark, sf).select("prompt_id", F.array_join(tx.simple_entities(F.col("prompt")), "|").alias("entities"))


@query("p18_document_urls", """SELECT page_id, coalesce(nullif(CASE WHEN page_id%3=0 THEN url ELSE '' END,''), 'document/'||page_id||'v2') AS url,
 CASE WHEN page_id%3=0 THEN url ELSE 'arXiv:'||page_id||' (v2)' END AS shown, CASE WHEN page_id%3=0 THEN url ELSE 'https://arxiv.org/abs/'||page_id END AS link FROM pages""")
def urls_q(spark, sf):
    p = fx.table(spark, sf, "pages").withColumn("u", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(""))
    p = p.select("page_id", tx.result_url(F.col("u"), F.lit(""), F.concat(F.col("page_id").cast("string"), F.lit("v2"))).alias("url"))
    return p.withColumn("shown", tx.format_doc_id(F.col("url"))).withColumn("link", tx.resolve_doc_url(F.col("url")))


@query("p19_parse_summary_sections", with_views("""WITH b AS (SELECT prompt_id, 1::BIGINT AS section, 'First' AS title, 0 AS bullet_no, trim(prompt, ' ' || chr(10)) AS bullet FROM pairs
 UNION ALL SELECT prompt_id, 1, 'First', 1, trim(response, ' ' || chr(10)) FROM pairs UNION ALL SELECT prompt_id, 2, 'Second', 0, 'end' FROM pairs) SELECT * FROM b"""))
def sections_q(spark, sf):
    t = fx.prompt_pairs(spark, sf).select("prompt_id", F.concat(F.lit("1. **First:** - "), "prompt", F.lit("\n- "), "response", F.lit("\n2. **Second:** - end")).alias("text"))
    return tx.parse_summary_sections(t)


@query("p20_split_reasoning", with_views("SELECT prompt_id, trim(prompt) AS reasoning, trim('INSTRUCTION 1: '||response) AS instructions FROM pairs WHERE NOT contains(prompt,'INSTRUCTION 1:') UNION ALL SELECT 'p_'||prompt_id, '', trim(response) FROM pairs"))
def reasoning_q(spark, sf):
    p = fx.prompt_pairs(spark, sf)
    a = p.select("prompt_id", F.concat(F.lit("REASONING:"), "prompt", F.lit("INSTRUCTION 1: "), "response").alias("text"))
    b = p.select(F.concat(F.lit("p_"), "prompt_id").alias("prompt_id"), F.col("response").alias("text"))
    return tx.split_reasoning(a.unionByName(b)).drop("text")


_groups = " ".join("WHEN " + " OR ".join(f"contains(lower(text),{q(k)})" for k in keys) + f" THEN {q(n)}" for n, keys in lex.DOMAIN_KEYWORDS)


@query("p21_first_match_domain", f"SELECT doc_id, CASE {_groups} ELSE 'general' END AS domain FROM documents")
def domain_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.first_match_domain(F.col("text")).alias("domain"))


@query("p22_generation_status", "SELECT conv_id, turn, CASE WHEN t='' THEN 'error' WHEN trim(t)='' THEN 'fallback_final' WHEN contains(t,'graph-based data structure') AND contains(t,'visualization tools') AND contains(t,'algorithms to analyze') THEN 'fallback' ELSE 'success' END AS status FROM (SELECT conv_id, turn, CASE turn%4 WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN text||' graph-based data structure, visualization tools, algorithms to analyze' ELSE text END AS t FROM conversations)")
def status_q(spark, sf):
    m = F.col("turn") % 4
    t = F.when(m == 1, "").when(m == 2, "  ").when(m == 3, F.concat("text", F.lit(" graph-based data structure, visualization tools, algorithms to analyze"))).otherwise(F.col("text"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", tx.generation_status(t).alias("status"))


@query("p23_content_keywords", rf"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({toks('text')}) AS word FROM documents) WHERE NOT list_contains({lst(lex.STOP_WORDS)}, word) AND NOT regexp_full_match(word,'[0-9]+') GROUP BY ALL")
def content_q(spark, sf):
    return doc(spark, sf).select("doc_id", F.explode(tx.content_keywords(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("p24_stable_id", with_views("SELECT id, 'entity_'||substr(md5(label),1,8) AS stable FROM nodes"))
def stable_q(spark, sf):
    from threadgraph.catalog.graphs import _graph

    return _graph(spark, sf)[0].select("id", tx.stable_id(F.col("label"), "entity").alias("stable"))


@query("p25_surrogate_id", with_views("SELECT seq, 'user_' || substr(md5(graph_id || '|' || seq || '|user'), 1, 16) AS surrogate FROM triples"))
def surrogate_q(spark, sf):
    return fx.triples(spark, sf).select("seq", tx.surrogate_id(F.col("graph_id"), F.col("seq"), "user").alias("surrogate"))


@query("p26_paper_rows", "SELECT doc_id, CASE WHEN doc_id%2=0 OR n_chars//100=0 THEN 0.5 ELSE (n_chars//100)::DOUBLE END AS score, substr(split_part(text, chr(10), 1), 1, 100) AS title FROM documents WHERE trim(text)<>''")
def papers_q(spark, sf):
    d = doc(spark, sf).select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 1, F.floor(F.col("n_chars") / 100).cast("double")).alias("_score"))
    return tx.paper_rows(d).select("doc_id", "score", "title")


@query("w12_papers_rank", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE trim(text)<>'') WHERE rank<=3")
def papers_rank_q(spark, sf):
    from threadgraph.operators.common import top_k

    d = tx.paper_rows(doc(spark, sf).select("source", "doc_id", "text", F.col("n_chars").cast("double").alias("score")))
    return top_k(d, ["source"], [F.col("score").desc(), F.col("doc_id")], 3, "rank").select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("p27_sentences", rf"SELECT doc_id, generate_subscripts(s,1)-1 AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, {sents('text')} AS s FROM documents)")
def sentences_q(spark, sf):
    d = doc(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return d.withColumn("sentence_no", F.col("sentence_no").cast("long"))


@query("p28_token_cosine", with_views(rf"WITH t AS (SELECT prompt_id, {toks('prompt')} AS a, {toks('response')} AS b FROM pairs) SELECT prompt_id, {RND(cos('a','b'))} AS similarity FROM t"))
def token_cosine_q(spark, sf):
    return fx.prompt_pairs(spark, sf).select("prompt_id", rnd(tx.token_cosine(tx.words(F.col("prompt")), tx.words(F.col("response")))).alias("similarity"))


def _layer_sql(groups, col, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({col}),{q(k)})" for k in keys) + f" THEN {q(n)}" for n, keys in groups) + f" ELSE {q(default)} END"


@query("p30_layer_by_keyword", f"SELECT doc_id, {_layer_sql(lex.LAYER_KEYWORDS_LONG,'text','unknown')} AS long_form, {_layer_sql(lex.LAYER_KEYWORDS_SHORT,'text','unknown')} AS short_form, {_layer_sql(lex.LAYER_KEYWORDS_PATH,'text','business')} AS path_form, {_layer_sql(lex.LAYER_KEYWORDS_VIEW,'text','other')} AS view_form FROM documents")
def layers_q(spark, sf):
    t = F.col("text")
    return doc(spark, sf).select("doc_id", tx.layer_by_keyword(t).alias("long_form"), tx.layer_by_keyword(t, lex.LAYER_KEYWORDS_SHORT).alias("short_form"),
                                 tx.layer_by_keyword(t, lex.LAYER_KEYWORDS_PATH, "business").alias("path_form"), tx.layer_by_keyword(t, lex.LAYER_KEYWORDS_VIEW, "other").alias("view_form"))


@query("p34_split_keywords", "SELECT item_id, array_to_string(list_transform(string_split(text, ','), lambda x: trim(x)), '|') AS keywords FROM benchmark")
def split_keywords_q(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", F.array_join(tx.split_keywords(F.col("text")), "|").alias("keywords"))


@query("p35_join_texts", "SELECT conv_id, CASE WHEN length(t)>500 THEN substr(t,1,500)||'...' ELSE t END AS text FROM (SELECT conv_id, string_agg(text, chr(10)||chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)")
def join_texts_q(spark, sf):
    return tx.join_texts(fx.table(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


FRAGMENTS = ["the", "tion", "and", "on", "er", "ment", "que"]


@query("j11_lexicon_counts", f"SELECT doc_id, {cnt('lower(text)', FRAGMENTS)} AS n_terms, {occ('lower(text)', FRAGMENTS)}::BIGINT AS n_occurrences FROM documents")
def lexicon_q(spark, sf):
    return doc(spark, sf).select("doc_id", tx.lexicon_count(F.lower("text"), FRAGMENTS).alias("n_terms"), tx.occurrences(F.lower("text"), FRAGMENTS).alias("n_occurrences"))


# --- scores: one chain of steps, several results -------------------------------------------

def score_chain(src: str) -> str:
    ents = rf"list_distinct(list_concat(list_filter(regexp_split_to_array(prompt, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]+')), list_filter({lst(lex.NAMED_TERMS)}, lambda x: contains(lower(prompt), lower(x)))))"
    intent = "(" + "|".join(lex.INTENT_WORDS) + ")"
    best = " ".join(f"WHEN c{i}=greatest({','.join(f'c{j}' for j in range(len(lex.DOMAIN_TERMS)))}) THEN {i}" for i in range(len(lex.DOMAIN_TERMS)))
    dom_terms = "CASE bd " + " ".join(f"WHEN {i} THEN {lst(sorted({w for t in terms for w in t.split(' ')}))}" for i, terms in enumerate(lex.DOMAIN_TERMS.values())) + " END"
    steps = "+".join(f"len(regexp_extract_all(low, {q(p)}))" for p in lex.STEP_PATTERNS)
    keys = lambda w: f"list_distinct(list_filter({w}, lambda x: NOT list_contains({lst(lex.STOP_WORDS)}, x) AND length(x)>2))"
    reqs = "list_concat(" + ",".join(rf"regexp_extract_all(plow, '{w}\s+([\p{{L}}\p{{N}}_]+(?:\s+[\p{{L}}\p{{N}}_]+)?)', 1)" for w in lex.REQUIREMENT_WORDS) + ")"
    return rf"""WITH src AS ({src}),
 t0 AS (SELECT *, lower(response) AS low, lower(prompt) AS plow, {toks('response')} AS w, {toks('prompt')} AS pw, {sents('response')} AS ss, string_split(response, chr(10)) AS ln FROM src),
 sx AS (SELECT key, generate_subscripts(ss,1) AS i, list_distinct({toks('s1')}) AS tk FROM (SELECT key, ss, unnest(ss) AS s1, generate_subscripts(ss,1) AS i0 FROM t0)),
 sy AS (SELECT key, i0 AS i, list_distinct({toks('s1')}) AS tk FROM (SELECT key, unnest(ss) AS s1, generate_subscripts(ss,1) AS i0 FROM t0)),
 fl AS (SELECT a.key, avg({cos('a.tk','b.tk')}) AS fa, coalesce(var_samp({cos('a.tk','b.tk')}),0) AS fv, count(*) AS fk FROM sy a JOIN sy b ON a.key=b.key AND b.i=a.i+1 GROUP BY 1),
 t1 AS (SELECT t0.*, coalesce(fk,0) AS fk, coalesce(fa,0) AS fa, coalesce(fv,0) AS fv, {cos('pw','w')} AS sim, list_filter(ln, lambda x: trim(x)<>'') AS fln, greatest({ntok('response')},1) AS nw, greatest(len(ss),1) AS ns,
  {ents} AS ents, {','.join(f"{cnt('low', t)} AS c{i}" for i, t in enumerate(lex.DOMAIN_TERMS.values()))} FROM t0 LEFT JOIN fl USING (key)),
 t2 AS (SELECT *, CASE {best} END AS bd, CASE WHEN fk=0 THEN 0.5 WHEN fa>=0.3 AND fa<=0.7 THEN 1.0 WHEN fa<0.3 THEN fa/0.3 ELSE greatest(0.0, 1-(fa-0.7)/0.3) END AS flow,
  list_distinct(regexp_extract_all(plow, '\b{intent}\b', 1)) AS wi, list_distinct(regexp_extract_all(low, '\b{intent}\b', 1)) AS gi, {keys('pw')} AS pk, {keys('w')} AS rk, {reqs} AS rq,
  CASE WHEN len(fln)>0 THEN list_avg(list_transform(fln, lambda x: length(x)::DOUBLE)) END AS ml,
  CASE WHEN len(fln)>0 THEN list_avg(list_transform(fln, lambda x: 0.25::DOUBLE*((regexp_matches(lower(trim(x)), '^({'|'.join(lex.LINE_VERBS)})'))::INT + regexp_matches(' '||lower(trim(x)), '[^\p{{L}}\p{{N}}_](?:in|on|at|using|with|from|to)\s+[\p{{L}}\p{{N}}_]+')::INT
    + (length(trim(x)) BETWEEN 15 AND 120)::INT + regexp_matches(lower(x), '{'|'.join(lex.CONCRETE_NOUNS)}')::INT))) ELSE 0.0 END AS cl FROM t1),
 t3 AS (SELECT *, greatest({','.join(f'c{j}' for j in range(len(lex.DOMAIN_TERMS)))}) AS bc, {dom_terms} AS bt FROM t2),
 sc AS (SELECT key, sim, fk, fa, fv, flow, low, response, prompt, ents, ln, pw,
  {RND(f"sim*0.40::DOUBLE + {share(cnt('low', lex.ACTION_VERBS), 5)}*0.25::DOUBLE + greatest(0.0, 1-{cnt('low', lex.VAGUE_TERMS)}/3.0::DOUBLE)*0.20::DOUBLE + {share(cnt('low', lex.CONCRETE_TERMS), 3)}*0.15::DOUBLE", 4)} AS actionability,
  {RND(f"least({occ('low', lex.SEQUENCE_TERMS)}/ns,1.0)*0.30::DOUBLE + {share(cnt('low', lex.DEPENDENCY_WORDS), 3)}*0.25::DOUBLE + {share('(' + steps + ')', 3)}*0.25::DOUBLE + flow*0.20::DOUBLE", 4)} AS coherence,
  {RND(f"least(bc/greatest(len({wsplit('response')}),1)*100.0::DOUBLE,1.0)*0.50::DOUBLE + {cos('bt','w')}*0.30::DOUBLE + greatest(0.0, 1-least({cnt('low', lex.GENERIC_TERMS)}/5.0::DOUBLE,0.5))*0.20::DOUBLE", 4)} AS domain_specificity,
  {RND(f"{share(cnt('low', lex.TECHNICAL_TERMS), 5)}*0.40::DOUBLE + {share(cnt('low', lex.SPECIFIC_TOOLS), 3)}*0.30::DOUBLE + {share(cnt('low', lex.IMPLEMENTATION_TERMS), 4)}*0.20::DOUBLE + {share(cnt('low', lex.CODE_TERMS), 2)}*0.10::DOUBLE", 4)} AS technological_specificity,
  CASE WHEN length(trim(response))<10 THEN 0.0 ELSE least(10.0, greatest(0.0, (
   (len(list_filter(ln, lambda x: regexp_matches(x, '^\s*[\d\-\*\+•]')))>0)::INT + (len(list_filter(fln, lambda x: regexp_matches(x, '^#+\s') OR (x=upper(x) AND x<>lower(x) AND length(x)<50)))>0)::INT + contains(response, chr(10)||chr(10))::INT + coalesce((ml BETWEEN 20 AND 100)::INT,0))/4.0::DOUBLE*3
   + (greatest(0.0, 1-(nw/ns-15)/30.0::DOUBLE)+greatest(0.0, 1-len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}{{7,}}')))/nw*2))/2*2.5::DOUBLE + cl*2.5::DOUBLE
   + (1-(least(1.0, nw/ns/25.0::DOUBLE)+least(1.0, len(list_filter(w, lambda x: list_contains({lst(lex.JARGON)}, x)))/nw*20))/2)*2)) END AS understandability,
  least(10.0, greatest(0.0, CASE WHEN len(ents)>0 THEN least(4.0, len(list_filter(ents, lambda x: contains(low, lower(x))))*0.8::DOUBLE) ELSE 2.0 END
   + CASE WHEN len(wi)>0 THEN len(list_intersect(wi,gi))/len(wi) ELSE 1.0 END*3 + CASE WHEN len(pk)>0 THEN len(list_intersect(pk,rk))/len(pk) ELSE 1.0 END*2 + CASE WHEN len(rq)>0 THEN len(list_filter(rq, lambda x: contains(low, x)))/len(rq) ELSE 1.0 END)) AS user_focus FROM t3),
 fin AS (SELECT *, {RND("actionability*0.10::DOUBLE + coherence*0.30::DOUBLE + technological_specificity*0.20::DOUBLE + domain_specificity*0.10::DOUBLE + understandability/10*0.15::DOUBLE + user_focus/10*0.15::DOUBLE", 4)} AS overall FROM sc) """


PAIR_CHAIN = score_chain("SELECT prompt_id AS key, prompt, response FROM pairs").replace(
    "sx AS (SELECT key, generate_subscripts(ss,1) AS i, list_distinct(" + toks("s1") + ") AS tk FROM (SELECT key, ss, unnest(ss) AS s1, generate_subscripts(ss,1) AS i0 FROM t0)),", "")


def _scored(spark, sf):
    return sc.score_texts(fx.prompt_pairs(spark, sf))


@query("t2_t8_score_texts", with_views(PAIR_CHAIN + f"SELECT key AS prompt_id, actionability, coherence, domain_specificity, technological_specificity, {RND('understandability')} AS understandability, {RND('user_focus')} AS user_focus, overall FROM fin"))
def score_texts_q(spark, sf):
    s = _scored(spark, sf)
    return s.select("prompt_id", "actionability", "coherence", "domain_specificity", "technological_specificity", rnd(F.col("understandability")).alias("understandability"), rnd(F.col("user_focus")).alias("user_focus"), "overall")


@query("t1_instruction_metrics", with_views(PAIR_CHAIN + f""", m AS (SELECT key AS prompt_id, least(10.0::DOUBLE, 2.0::DOUBLE*len(list_filter(list_transform(ents, lambda x: lower(x)), lambda x: x<>'' AND contains(low, x)))) AS user_focus, least(10.0::DOUBLE, {cnt('low', lex.SIMPLE_TECH_TERMS)}*1.5::DOUBLE) AS technological_specificity,
 least(10.0::DOUBLE, {cnt('low', lex.SIMPLE_ACTION_VERBS)}*2.0::DOUBLE) AS actionability, least(10.0::DOUBLE, 5.0::DOUBLE + CASE WHEN contains(low,'instruction 1') AND contains(low,'instruction 2') THEN 2 ELSE 0 END + CASE WHEN len({wsplit('response')})>30 THEN 1 ELSE 0 END + CASE WHEN len(ln)>2 THEN 1 ELSE 0 END) AS coherence,
 {RND('sim', 4)} AS semantic_similarity, least(10.0::DOUBLE, len(list_intersect(pw, {lst(lex.SIMPLE_DOMAINS)}))::DOUBLE) AS domain_specificity FROM sc)
 SELECT *, {RND("user_focus*0.25::DOUBLE+technological_specificity*0.15::DOUBLE+actionability*0.2::DOUBLE+coherence*0.15::DOUBLE+semantic_similarity*0.1::DOUBLE+domain_specificity*0.15::DOUBLE", 4)} AS overall_effectiveness FROM m"""))
def instruction_q(spark, sf):
    p = sc.prepare(fx.prompt_pairs(spark, sf))
    m = sc.instruction_metrics()
    return p.select("prompt_id", *[v.alias(k) for k, v in m.items()])


@query("t9_score_responses", with_views(score_chain("SELECT prompt_id||'#gnn' AS key, prompt, response FROM pairs UNION ALL SELECT prompt_id||'#mcts', prompt, prompt FROM pairs UNION ALL SELECT prompt_id||'#rmodel', prompt, prompt||' '||response FROM pairs").replace(
    "sx AS (SELECT key, generate_subscripts(ss,1) AS i, list_distinct(" + toks("s1") + ") AS tk FROM (SELECT key, ss, unnest(ss) AS s1, generate_subscripts(ss,1) AS i0 FROM t0)),", "")
    + "SELECT split_part(key,'#',1) AS prompt_id, " + ", ".join(f"max({k}) FILTER (key LIKE '%#{m}') AS {m}_{k}" for m in ("gnn", "mcts", "rmodel") for k in sc.SCORES) + " FROM fin GROUP BY 1"))
def responses_q(spark, sf):
    p = fx.prompt_pairs(spark, sf)
    models = F.array(F.struct(F.lit("gnn").alias("m"), F.col("response").alias("t")), F.struct(F.lit("mcts").alias("m"), F.col("prompt").alias("t")), F.struct(F.lit("rmodel").alias("m"), F.concat_ws(" ", "prompt", "response").alias("t")))
    long = p.select("prompt_id", "prompt", F.explode(models).alias("x")).select("prompt_id", "prompt", F.col("x.m").alias("model"), F.col("x.t").alias("response"))
    return sc.score_responses(long)


@query("w8_sentence_flow", with_views(PAIR_CHAIN + f"SELECT key AS prompt_id, {RND('flow')} AS flow FROM sc"))
def flow_q(spark, sf):
    return sc.prepare(fx.prompt_pairs(spark, sf)).select("prompt_id", rnd(sc.flow_score()).alias("flow"))


@query("t14_logical_flow", with_views(PAIR_CHAIN + rf""", d AS (SELECT *, len(list_filter({wsplit('low')}, lambda x: list_contains({lst(lex.TRANSITION_WORDS)}, x)))/greatest(len({wsplit('low')}),1) AS dens FROM sc)
 SELECT key AS prompt_id, CASE WHEN fk=0 THEN 1.0 ELSE {RND('fa',4)} END AS coherence_score, CASE WHEN fk=0 THEN 0.0 ELSE {RND('dens',4)} END AS transition_word_density, CASE WHEN fk=0 THEN 0.0 ELSE {RND('fv',4)} END AS sentence_similarity_variance,
 CASE WHEN fk=0 THEN 1.0 ELSE {RND('greatest(0.0, least(1.0, dens*2*0.3::DOUBLE+fa*0.4::DOUBLE+(1-fv)*0.3::DOUBLE))',4)} END AS logical_flow_score FROM d"""))
def logical_q(spark, sf):
    return sc.logical_flow(fx.prompt_pairs(spark, sf).drop("prompt")).drop("response")


@query("t10_prompt_complexity", rf"""WITH t AS (SELECT doc_id, {ntok('text')} AS k, greatest(len({sents('text')}),1) AS n, len(list_filter({toks('text')}, lambda x: list_contains({lst(lex.CLAUSE_WORDS)}, x))) AS c FROM documents)
 SELECT doc_id, k AS token_count, {RND('k/n',2)} AS avg_sentence_length, {RND('c/n',2)} AS clause_density, {RND('k/n/20*0.3::DOUBLE+c/n/2*0.3::DOUBLE',4)} AS syntactic_complexity_score FROM t""")
def complexity_q(spark, sf):
    return sc.prompt_complexity(doc(spark, sf).select("doc_id", "text"), "text").drop("text")


_own = {d: toks(q(" ".join(t))) for d, t in lex.DOMAIN_TERMS.items()}
_near = ", ".join(f"{RND(cos('w', _own[d]), 4)} AS s_{d}" for d in lex.DOMAIN_TERMS)
_top = f"greatest({','.join('s_' + d for d in lex.DOMAIN_TERMS)})"


@query("t12_domain_profile", f"WITH w AS (SELECT *, {toks('text')} AS w FROM documents), t AS (SELECT doc_id, text, {_near}, " + ", ".join(f"{cnt('lower(text)', t)} AS {d}_term_frequency" for d, t in lex.DOMAIN_TERMS.items()) + f""" FROM w)
 SELECT doc_id, {", ".join(d + "_term_frequency" for d in lex.DOMAIN_TERMS)}, {RND("(" + "+".join(d + "_term_frequency" for d in lex.DOMAIN_TERMS) + f")/greatest(len({wsplit('text')}),1)", 4)} AS domain_term_density,
 CASE """ + " ".join(f"WHEN s_{d}={_top} THEN {q(d)}" for d in lex.DOMAIN_TERMS) + f" END AS dominant_domain, {_top} AS max_domain_similarity FROM t")
def domain_profile_q(spark, sf):
    return sc.domain_profile(doc(spark, sf).select("doc_id", "text"), "text").drop("text")


@query("t13_readability", rf"""WITH t AS (SELECT doc_id, greatest(len({toks('text')}),1) AS w, greatest(len({sents('text')}),1) AS s, greatest(len(regexp_extract_all(lower(text),'[aeiouy]+')), greatest(len({toks('text')}),1)) AS y FROM documents)
 SELECT doc_id, {RND('206.835::DOUBLE-1.015::DOUBLE*(w/s)-84.6::DOUBLE*(y/w)',2)} AS flesch_reading_ease, {RND('0.39::DOUBLE*(w/s)+11.8::DOUBLE*(y/w)-15.59::DOUBLE',2)} AS flesch_kincaid_grade FROM t""")
def readability_q(spark, sf):
    return sc.readability(doc(spark, sf).select("doc_id", "text")).drop("text")
