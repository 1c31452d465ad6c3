"""Diagnosis of many symptoms at once: gate, retrieve, walk, render, generate."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship_by_value
from ..functions import lexicons as L
from ..functions.text import collapse, content_terms, salience, short_terms
from ..operators import evals, filters, graph, index
from .lineage import cut

DECLINED = "no source matched; defer to the manual procedure"
# Fixed value: how the answer of a model that could not be reached begins.
UNAVAILABLE = "(generation unavailable:"
LOCAL_PREFIXES = ("http://localhost", "http://127.", "http://[::1]", "https://localhost", "https://127.", "https://[::1]")

Generator = Callable[[str, str], str]


def echo_generator(prompt: str, tag: str) -> str:
    """The offline default: the prompt's last line with its tag; always the same for the same prompt."""
    return f"{prompt.strip().splitlines()[-1] if prompt.strip() else 'SKIP'} {tag}".strip()


def require_local(url: str, allow_remote: bool = False) -> str:
    """The url of a model on this host; others are refused unless allowed."""
    if not allow_remote and not url.startswith(LOCAL_PREFIXES):
        raise ValueError("the generator's address must be local")
    return url


def with_retries(
    generate: Generator, tries: int = 4, pause: float = 2.0, before_retry: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep
) -> Generator:
    """``generate``, asked again after an error or an empty answer; what is left after all tries is a sentinel.

    The waits grow by ``pause`` each time; ``before_retry`` may load the model anew.
    """

    def run(prompt: str, tag: str) -> str:
        last = "unknown"
        for k in range(tries):
            try:
                if text := (generate(prompt, tag) or "").strip():
                    return text
                last = "empty"
            except (OSError, ValueError) as e:
                last = type(e).__name__
            if k < tries - 1:
                if before_retry is not None:
                    before_retry()
                sleep(pause * (k + 1))
        return f"{UNAVAILABLE} {last})"

    return run


def generated(prompts: DataFrame, generate: Generator = echo_generator) -> DataFrame:
    """``prompts`` (key, prompt, tag) with ``answer``; rows stream through in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=[generate(p, t) for p, t in zip(pdf["prompt"], pdf["tag"])])

    return prompts.select("key", "prompt", "tag").mapInPandas(run, "key string, prompt string, tag string, answer string")


def step_label(component: Column, signature: Column) -> Column:
    first = F.coalesce(F.nullif(component, F.lit("")), signature, F.lit(""))
    return F.coalesce(F.nullif(collapse(first, 90), F.lit("")), F.lit("(section)"))


def render_chains(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, block): every chain's steps with their tags, as a prompt block in chain order.

    segments: ord, source_doc, component, signature, raw_text.
    """
    steps = paths.select("query_id", "chain", F.posexplode("path").alias("p", "ord"))
    steps = index.sent(steps).join(segments, "ord")
    tag = F.format_string("[C%d.%d]", F.col("chain"), F.col("p") + 1)
    line = F.concat(
        F.when(F.col("p") == 0, "  ").otherwise("    -> "), tag, F.lit(" "),
        step_label(F.col("component"), F.col("signature")), F.lit(" :: "), collapse(F.col("raw_text"), 180),
    )
    lines = steps.select("query_id", "chain", F.struct("p", line.alias("line"), "source_doc").alias("s")).groupBy("query_id", "chain").agg(
        F.array_sort(F.collect_list("s")).alias("ss")
    )
    head = F.concat(F.format_string("CHAIN %d", F.col("chain")), F.lit(" of "), F.coalesce(F.get("ss", F.lit(0))["source_doc"], F.lit("")))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("ss", lambda s: s["line"]), "\n"))
    return lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chain", text.alias("t")))).alias("cs")).select(
        "query_id", F.array_join(F.transform("cs", lambda c: c["t"]), "\n").alias("block")
    )


def nested_chains(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, chains): the same chains as ``render_chains`` as nested rows, in chain order.

    A chain has its number, entry_doc, n_steps and steps (tag, label, doc, snippet of 120 characters, id);
    segments: ord, id, source_doc, component, signature, raw_text.
    """
    steps = paths.select("query_id", "chain", F.posexplode("path").alias("p", "ord"))
    steps = index.sent(steps).join(segments, "ord")
    step = F.struct(
        F.format_string("[C%d.%d]", F.col("chain"), F.col("p") + 1).alias("tag"), step_label(F.col("component"), F.col("signature")).alias("label"),
        F.col("source_doc").alias("doc"), F.substring(collapse(F.col("raw_text"), 180), 1, 120).alias("snippet"), F.col("id"),
    )
    each = steps.groupBy("query_id", "chain").agg(F.array_sort(F.collect_list(F.struct("p", step.alias("step")))).alias("s"))
    listed = F.transform("s", lambda x: x["step"])
    chain = F.struct("chain", F.get(listed, F.lit(0))["doc"].alias("entry_doc"), F.size("s").alias("n_steps"), listed.alias("steps"))
    return each.groupBy("query_id").agg(F.array_sort(F.collect_list(chain)).alias("chains"))


def diagnose_chains(
    symptoms: DataFrame, segments: DataFrame, edges: DataFrame, entries: int = 8, pool: int = 16, rel: float = 0.4, depth: int = 3,
    gate: bool = True, generate: Generator = echo_generator,
) -> DataFrame:
    """(query_id, declined, gate_term, n_chains, coverage, answer) of every symptom.

    symptoms: query_id, symptom; segments: ord, raw_text, signature, component, source_doc, symptoms.
    """
    term = filters.out_of_domain(F.col("symptom"))
    asked = symptoms.where(term.isNull()) if gate else symptoms
    idx = index.build_index(filters.clean_corpus(segments), F.coalesce(F.nullif("signature", F.lit("")), "raw_text"))
    edges = cut(edges)
    found, asked_by = index.effective_best(idx, asked, pool)
    chosen = cut(graph.pick_entries(found, edges, entries))
    # Read by every step of the walks; to 9 places, so that ties don't hang on the order of a sum.
    scores = cut(index.score(idx, asked_by, pairs=graph.within(chosen, edges, depth)).withColumn("score", F.round("score", 9)))
    paths = cut(graph.chase(chosen, edges, scores, rel, depth))
    blocks = render_chains(paths, segments).join(paths.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chains")), "query_id")
    vocabulary = segments.select(F.explode("symptoms").alias("s")).select(F.explode(short_terms(F.col("s"))).alias("tok"))
    dial = index.coverage(symptoms, vocabulary)
    answers = generated(blocks.select(F.col("query_id").cast("string").alias("key"), F.col("block").alias("prompt"), F.lit("").alias("tag")), generate)
    return (
        symptoms.join(blocks.select("query_id", "n_chains"), "query_id", "left").join(dial, "query_id", "left")
        .join(answers.select("key", "answer"), F.col("query_id").cast("string") == F.col("key"), "left")
        .select(
            "query_id", F.col("answer").isNull().alias("declined"), (term if gate else F.lit(None).cast("string")).alias("gate_term"),
            F.coalesce("n_chains", F.lit(0)).alias("n_chains"), "coverage", (F.col("coverage") < L.COVERAGE_CUT).alias("coverage_flag"),
            F.coalesce("answer", F.lit(DECLINED)).alias("answer"),
        )
    )


def diagnose_points(symptoms: DataFrame, segments: DataFrame, k: int = 6, generate: Generator = echo_generator) -> DataFrame:
    """One lead for each retrieved source, with the dials: query_id, dials, n_grounded, n_inferred, diagnosis.

    Every symptom has a row.  Without a lead it is ``declined``, and ``unavailable`` as well if a
    model could not be reached, so that an outage isn't taken for a gap in the manuals.
    """
    idx = index.build_index(filters.clean_corpus(segments), F.coalesce(F.nullif("signature", F.lit("")), "raw_text"))
    found = index.sent(index.search(idx, symptoms, k)).join(segments.select("ord", "raw_text", "source_doc"), "ord").join(symptoms, "query_id")
    tag = F.format_string("[S%d]", F.col("rank"))
    keyed = found.withColumns({"tag": tag, "key": F.concat_ws("/", F.col("query_id").cast("string"), tag)})
    prompt = F.concat(F.lit("SYMPTOM: "), "symptom", F.lit("\nSOURCE:\n"), F.coalesce("raw_text", F.lit("")))
    answers = cut(generated(keyed.select("key", prompt.alias("prompt"), "tag"), generate).select("key", "answer"))
    answered = keyed.join(answers, "key")
    failed = F.col("answer").startswith(UNAVAILABLE)
    down = answered.where(failed).groupBy("query_id").agg(F.min("answer").alias("failure"))
    leads = answered.where(~failed & ~filters.is_skip(F.col("answer"))).withColumn("grounded", F.contains("answer", F.col("tag")))
    leads = leads.withColumn("text", F.when(F.col("grounded"), F.col("answer")).otherwise(F.concat("answer", F.lit(" "), "tag")))
    terms = content_terms(F.regexp_replace("text", r"(?i)\[S\d+\]", ""))
    points = leads.select(
        "query_id", "rank", "text", "grounded", terms.alias("text_terms"), content_terms(F.col("raw_text")).alias("src_terms"),
        content_terms(salience(F.col("symptom"))).alias("echo"),
    )
    dials = evals.citation_dials(points, found.select("query_id", "raw_text"))
    extr = F.coalesce(F.try_divide(F.size(F.array_intersect("text_terms", "src_terms")), F.size("text_terms")), F.lit(0.0))
    marks = F.concat(
        F.when(F.col("grounded"), "").otherwise("  (inferred from source: verify)"),
        F.when(extr < L.WEAK_LEAD, "  (weakly sourced: verify against source)").otherwise(""),
    )
    ordered = points.select("query_id", "grounded", F.struct("rank", F.concat("text", marks).alias("line")).alias("l"))
    text = ordered.groupBy("query_id").agg(
        F.array_sort(F.collect_list("l")).alias("ls"), F.count_if("grounded").alias("n_grounded"), F.count_if(~F.col("grounded")).alias("n_inferred")
    )
    numbered = F.array_join(F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    told = dials.join(text.select("query_id", "n_grounded", "n_inferred", numbered.alias("diagnosis")), "query_id")
    declined = F.col("n_points").isNull()
    full = symptoms.select("query_id").join(told, "query_id", "left").join(down, "query_id", "left")
    return full.withColumns({
        "declined": declined, "unavailable": declined & F.col("failure").isNotNull(),
        "diagnosis": F.coalesce("diagnosis", "failure", F.lit(DECLINED)),
        **{c: F.coalesce(c, F.lit(0)) for c in ("n_points", "n_grounded", "n_inferred")},
    }).drop("failure")


ship_by_value(__name__)
