"""Text scores as column expressions over (prompt, response); one map stage, no Python.

``similarity`` is any column in [0, 1]; by default the token cosine of the two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.functions import lexicons as lex
from threadgraph.functions.text import (
    bind, lexicon_count, lit_array, occurrences, sentences, simple_entities, token_cosine, token_count, words,
)
from threadgraph.operators.common import rnd


def _share(count: Column, full: float) -> Column:
    return F.least(count / F.lit(float(full)), F.lit(1.0))


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)


def prepare(df: DataFrame, text: str = "response", prompt: str = "prompt") -> DataFrame:
    """Lower-case forms, words, sentences and lines, computed once per row."""
    out = df.withColumns({"_low": F.lower(text), "_words": words(F.col(text)), "_sents": sentences(F.col(text)), "_lines": F.split(F.col(text), "\n")})
    if prompt in df.columns:
        out = out.withColumns({"_plow": F.lower(prompt), "_pwords": words(F.col(prompt)), "_ents": simple_entities(F.col(prompt))})
        if "similarity" not in df.columns:
            out = out.withColumn("similarity", token_cosine(F.col("_pwords"), F.col("_words")))
    out = out.withColumn("_toks", F.transform("_sents", lambda s: F.array_distinct(words(s))))
    toks = F.col("_toks")
    return out.withColumn("_flow", F.when(F.size("_sents") > 1, F.transform(F.sequence(F.lit(1), F.size("_sents") - 1), lambda i: token_cosine(F.get(toks, i - 1), F.get(toks, i)))).otherwise(F.array().cast("array<double>")))


def drop_prepared(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def instruction_metrics(entities: Column | None = None) -> dict[str, Column]:
    """Simple 0-10 instruction metrics; the domain score looks at the prompt only."""
    low = F.col("_low")
    ents = entities if entities is not None else F.transform("_ents", lambda e: F.lower(e))
    focus = F.size(F.filter(ents, lambda e: (e != "") & F.contains(low, e))) * 2.0
    cap = lambda c: F.least(F.lit(10.0), c)
    n_words = F.size(F.filter(F.split(F.col("response"), r"\s+"), lambda w: w != ""))
    both = F.contains(low, F.lit("instruction 1")) & F.contains(low, F.lit("instruction 2"))
    coh = 5.0 + F.when(both, 2.0).otherwise(0.0) + F.when(n_words > 30, 1.0).otherwise(0.0) + F.when(F.size("_lines") > 2, 1.0).otherwise(0.0)
    domain = F.size(F.array_intersect("_pwords", lit_array(lex.SIMPLE_DOMAINS))).cast("double")
    m = {
        "user_focus": cap(focus), "technological_specificity": cap(lexicon_count(low, lex.SIMPLE_TECH_TERMS) * 1.5),
        "actionability": cap(lexicon_count(low, lex.SIMPLE_ACTION_VERBS) * 2.0), "coherence": cap(coh),
        "semantic_similarity": rnd(F.col("similarity"), 4), "domain_specificity": cap(domain),
    }
    m["overall_effectiveness"] = rnd(sum((m[k] * w for k, w in lex.SIMPLE_WEIGHTS.items()), F.lit(0.0)), 4)
    return m


def actionability() -> Column:
    low = F.col("_low")
    vague = F.greatest(F.lit(0.0), 1.0 - lexicon_count(low, lex.VAGUE_TERMS) / 3.0)
    score = F.col("similarity") * 0.40 + _share(lexicon_count(low, lex.ACTION_VERBS), 5) * 0.25 + vague * 0.20 + _share(lexicon_count(low, lex.CONCRETE_TERMS), 3) * 0.15
    return F.when((F.col("response") == "") | (F.col("prompt") == ""), 0.0).otherwise(rnd(score, 4))


def flow_score() -> Column:
    """1 for a mean similarity of neighbours in [.3, .7], linear outside, .5 for one sentence."""
    avg = _mean(F.col("_flow"))
    return (F.when(F.size("_flow") == 0, 0.5).when((avg >= 0.3) & (avg <= 0.7), 1.0).when(avg < 0.3, avg / 0.3)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - (avg - 0.7) / 0.3)))


def coherence() -> Column:
    low = F.col("_low")
    seq = occurrences(low, lex.SEQUENCE_TERMS)
    steps = sum((F.regexp_count(low, F.lit(p)) for p in lex.STEP_PATTERNS), F.lit(0))
    score = F.least(seq / F.greatest(F.size("_sents"), F.lit(1)), F.lit(1.0)) * 0.30 + _share(lexicon_count(low, lex.DEPENDENCY_WORDS), 3) * 0.25 + _share(steps, 3) * 0.25 + flow_score() * 0.20
    return F.when(F.col("response") == "", 0.0).otherwise(rnd(score, 4))


def _word_total(text: str = "response") -> Column:
    return F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))


def add_domain(df: DataFrame, hint: Column | None = None, domains=lex.DOMAIN_TERMS) -> DataFrame:
    """``_dcount`` and ``_dterms`` of the hinted domain, else of the one with most terms (first on a tie)."""
    names = list(domains)
    df = df.withColumn("_counts", bind(F.col("_low"), lambda s: F.array(*[lexicon_count(s, t) for t in domains.values()])))
    pos = F.array_position("_counts", F.array_max("_counts")).cast("int")
    if hint is not None:
        pos = F.when(F.lower(hint).isin(*names), F.array_position(lit_array(names), F.lower(hint)).cast("int")).otherwise(pos)
    df = df.withColumn("_dpos", pos)
    vocab = F.array(*[lit_array(dict.fromkeys(w for t in terms for w in t.split(" "))) for terms in domains.values()])
    return df.withColumns({"_dcount": F.element_at("_counts", F.col("_dpos")), "_dterms": F.element_at(vocab, F.col("_dpos"))})


def domain_specificity() -> Column:
    """Term density (.5), likeness to the domain terms (.3) and absence of generic terms (.2)."""
    generic = F.greatest(F.lit(0.0), 1.0 - F.least(lexicon_count(F.col("_low"), lex.GENERIC_TERMS) / 5.0, F.lit(0.5)))
    density = F.least(F.col("_dcount") / F.greatest(_word_total(), F.lit(1)) * 100.0, F.lit(1.0))
    score = density * 0.50 + token_cosine(F.col("_dterms"), F.col("_words")) * 0.30 + generic * 0.20
    return F.when(F.col("response") == "", 0.0).otherwise(rnd(score, 4))


def technological_specificity() -> Column:
    low = F.col("_low")
    score = (_share(lexicon_count(low, lex.TECHNICAL_TERMS), 5) * 0.40 + _share(lexicon_count(low, lex.SPECIFIC_TOOLS), 3) * 0.30
             + _share(lexicon_count(low, lex.IMPLEMENTATION_TERMS), 4) * 0.20 + _share(lexicon_count(low, lex.CODE_TERMS), 2) * 0.10)
    return F.when(F.col("response") == "", 0.0).otherwise(rnd(score, 4))


def understandability() -> Column:
    """Structure (3), readability (2.5), step clarity (2.5) and low load (2)."""
    text, lines = F.col("response"), F.col("_lines")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    full = F.filter(lines, lambda s: F.trim(s) != "")
    header = F.exists(full, lambda s: s.rlike(r"^#+\s") | ((s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) < 50)))
    mean_len = _mean(F.transform(full, lambda s: F.length(s).cast("double")))
    structure = (flag(F.exists(lines, lambda s: s.rlike(r"^\s*[\d\-\*\+•]"))) + flag(header) + flag(F.contains(text, F.lit("\n\n")))
                 + flag((F.size(full) > 0) & (mean_len >= 20) & (mean_len <= 100))) / 4.0 * 3.0
    n_words, n_sents = F.greatest(token_count(text), F.lit(1)), F.greatest(F.size("_sents"), F.lit(1))
    per = n_words / n_sents
    long_words = F.regexp_count(text, F.lit(r"(?U)(?<!\w)\p{L}{7,}(?!\w)"))
    readability = (F.greatest(F.lit(0.0), 1.0 - (per - 15.0) / 30.0) + F.greatest(F.lit(0.0), 1.0 - long_words / n_words * 2.0)) / 2.0 * 2.5

    def clarity(line: Column) -> Column:
        s = F.trim(line)
        low = F.lower(s)
        verb = F.exists(lit_array(lex.LINE_VERBS), lambda v: F.startswith(low, v))
        noun = F.exists(lit_array(lex.CONCRETE_NOUNS), lambda v: F.contains(low, v))
        detail = low.rlike(r"(?U)\b(?:in|on|at|using|with|from|to)\s+\w+")
        return 0.25 * (flag(verb) + flag(detail) + flag((F.length(s) >= 15) & (F.length(s) <= 120)) + flag(noun))
    clear = F.when(F.size(full) > 0, _mean(F.transform(full, clarity)) * 2.5).otherwise(0.0)
    jargon = F.size(F.filter(F.col("_words"), lambda w: w.isin(*lex.JARGON)))
    load = (F.least(F.lit(1.0), per / 25.0) + F.least(F.lit(1.0), jargon / n_words * 20.0)) / 2.0
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), structure + readability + clear + (1.0 - load) * 2.0))
    return F.when(F.length(F.trim(text)) < 10, 0.0).otherwise(score)


def user_focus(entities: Column | None = None) -> Column:
    """Entity coverage (4), intent (3), keyword overlap (2), requirements (1)."""
    low, plow = F.col("_low"), F.col("_plow")
    ents = entities if entities is not None else F.col("_ents")
    covered = F.least(F.lit(4.0), F.size(F.filter(ents, lambda e: F.contains(low, F.lower(e)))) * 0.8)
    cover = F.when(F.size(ents) > 0, covered).otherwise(2.0)
    pattern = F.lit(r"\b(" + "|".join(lex.INTENT_WORDS) + r")\b")
    wanted = F.array_distinct(F.regexp_extract_all(plow, pattern, F.lit(1)))
    given = F.array_distinct(F.regexp_extract_all(low, pattern, F.lit(1)))
    intent = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, given)) / F.size(wanted)).otherwise(1.0)
    keys = lambda w: F.array_distinct(F.filter(w, lambda t: ~t.isin(*lex.STOP_WORDS) & (F.length(t) > 2)))
    pk, rk = keys(F.col("_pwords")), keys(F.col("_words"))
    overlap = F.when(F.size(pk) > 0, F.size(F.array_intersect(pk, rk)) / F.size(pk)).otherwise(1.0)
    reqs = F.flatten(F.array(*[F.regexp_extract_all(plow, F.lit(rf"(?U){w}\s+(\w+(?:\s+\w+)?)"), F.lit(1)) for w in lex.REQUIREMENT_WORDS]))
    met = F.when(F.size(reqs) > 0, F.size(F.filter(reqs, lambda r: F.contains(low, r))) / F.size(reqs)).otherwise(1.0)
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), cover + intent * 3.0 + overlap * 2.0 + met))
    return F.when((F.col("response") == "") | (F.col("prompt") == ""), 0.0).otherwise(score)


def overall_score(m: dict[str, Column]) -> Column:
    w = lex.OVERALL_WEIGHTS
    return rnd(m["actionability"] * w["actionability"] + m["coherence"] * w["coherence"] + m["technological_specificity"] * w["technological_specificity"]
               + m["domain_specificity"] * w["domain_specificity"] + m["understandability"] / 10 * w["understandability"] + m["user_focus"] / 10 * w["user_focus"], 4)


def score_texts(df: DataFrame, hint: Column | None = None) -> DataFrame:
    """All six metrics and the overall score per row of (prompt, response)."""
    p = add_domain(prepare(df), hint)
    p = p.withColumns({"actionability": actionability(), "coherence": coherence(), "domain_specificity": domain_specificity(),
                       "technological_specificity": technological_specificity(), "understandability": understandability(), "user_focus": user_focus()})
    cols = {k: F.col(k) for k in lex.OVERALL_WEIGHTS}
    return drop_prepared(p.withColumn("overall", overall_score(cols)))


SCORES = ["actionability", "coherence", "domain_specificity", "technological_specificity", "understandability", "user_focus", "overall"]


def score_responses(responses: DataFrame, hint: Column | None = None, models=("gnn", "mcts", "rmodel")) -> DataFrame:
    """Long (prompt_id, model, prompt, response) to one wide row per prompt."""
    s = score_texts(responses, hint)
    cols = [F.max(F.when(F.col("model") == m, F.col(k))).alias(f"{m}_{k}") for m in models for k in SCORES]
    return s.groupBy("prompt_id").agg(*cols)


def prompt_complexity(df: DataFrame, text: str = "prompt") -> DataFrame:
    sents = sentences(F.col(text))
    n = F.greatest(F.size(sents), F.lit(1))
    clauses = F.size(F.filter(words(F.col(text)), lambda w: w.isin(*lex.CLAUSE_WORDS)))
    df = df.withColumns({"token_count": token_count(F.col(text)).cast("long"), "_n": n, "_c": clauses})
    avg, dens = F.col("token_count") / F.col("_n"), F.col("_c") / F.col("_n")
    return df.withColumns({"avg_sentence_length": rnd(avg, 2), "clause_density": rnd(dens, 2), "syntactic_complexity_score": rnd(avg / 20 * 0.3 + dens / 2 * 0.3, 4)}).drop("_n", "_c")


def readability(df: DataFrame, text: str = "text") -> DataFrame:
    """Flesch reading ease and Flesch-Kincaid grade with vowel groups as syllables."""
    w = F.greatest(F.size(words(F.col(text))), F.lit(1))
    df = df.withColumns({"_w": w, "_s": F.greatest(F.size(sentences(F.col(text))), F.lit(1)), "_y": F.greatest(F.regexp_count(F.lower(text), F.lit("[aeiouy]+")), w)})
    per, syl = F.col("_w") / F.col("_s"), F.col("_y") / F.col("_w")
    return df.withColumns({"flesch_reading_ease": rnd(206.835 - 1.015 * per - 84.6 * syl, 2), "flesch_kincaid_grade": rnd(0.39 * per + 11.8 * syl - 15.59, 2)}).drop("_w", "_s", "_y")


def domain_profile(df: DataFrame, text: str = "prompt", domains=lex.DOMAIN_TERMS) -> DataFrame:
    """Term counts per domain, density over words, and the most similar domain (first on a tie).

    Similarity is the token cosine between the text and all terms of a domain, to four digits.
    """
    df = df.withColumn("_low", F.lower(text))
    low = F.col("_low")
    df = df.withColumns({f"{d}_term_frequency": lexicon_count(low, t) for d, t in domains.items()})
    total = sum((F.col(f"{d}_term_frequency") for d in domains), F.lit(0))
    n = F.greatest(F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")), F.lit(1))
    df = df.withColumns({"domain_term_density": rnd(total / n, 4), "_t": words(F.col(text))})
    own = lambda terms: words(F.lit(" ".join(terms)))
    df = df.withColumns({f"_s_{d}": rnd(token_cosine(F.col("_t"), own(t)), 4) for d, t in domains.items()})
    top = F.greatest(*[F.col(f"_s_{d}") for d in domains])
    dom = F.when(F.lit(False), F.lit(""))
    for d in domains:
        dom = dom.when(F.col(f"_s_{d}") == top, F.lit(d))
    return df.withColumns({"dominant_domain": dom, "max_domain_similarity": top}).drop("_low", "_t", *[f"_s_{d}" for d in domains])


def logical_flow(df: DataFrame, text: str = "response") -> DataFrame:
    """Transition density, neighbour similarity and its variance; one sentence scores 1."""
    p = prepare(df, text, prompt="_none")
    toks = F.filter(F.split("_low", r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(toks), F.lit(1))
    dens = F.size(F.filter(toks, lambda w: w.isin(*lex.TRANSITION_WORDS))) / n
    k = F.size("_flow")
    p = p.withColumns({"_avg": F.when(k > 0, _mean(F.col("_flow"))).otherwise(0.0), "_dens": dens})
    dev = F.aggregate(F.transform("_flow", lambda x: (x - F.col("_avg")) * (x - F.col("_avg"))), F.lit(0.0), lambda s, x: s + x)
    p = p.withColumn("_var", F.when(k > 1, dev / (k - 1)).otherwise(0.0))
    raw = F.col("_dens") * 2 * 0.3 + F.col("_avg") * 0.4 + (1 - F.col("_var")) * 0.3
    one = k == 0
    p = p.withColumns({
        "coherence_score": F.when(one, 1.0).otherwise(rnd(F.col("_avg"), 4)), "transition_word_density": F.when(one, 0.0).otherwise(rnd(F.col("_dens"), 4)),
        "sentence_similarity_variance": F.when(one, 0.0).otherwise(rnd(F.col("_var"), 4)),
        "logical_flow_score": F.when(one, 1.0).otherwise(rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4))})
    return drop_prepared(p)
