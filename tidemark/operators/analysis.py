"""Studies over decisions and chains: parts named, mechanisms, chain shape, structural match, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import contains_any, short_terms, squeezed
from ..plans.lineage import written
from . import graph, index

# Hyphenated part names that stay whole, and words for parts and for mechanisms alone.
WHOLE_PARTS = ("o-ring", "b-nut", "dc-dc", "quick-disconnect")
PART = (
    r"(?i)\b(switch|microswitch|relay|valve|poppet|spool|solenoid|actuator|regulator|diverter|"
    r"connector|wire|cable|harness|terminal|contact|plug|socket|receptacle|jumper|splice|"
    r"o-?ring|oring|seal|gasket|b-?nut|bellows|diaphragm|packing|grommet|"
    r"converter|inverter|transducer|sensor|amplifier|capacitor|diode|resistor|transistor|resolver|"
    r"potentiometer|oscillator|filter|circuit|board|condenser|rectifier|coil|winding|transformer|"
    r"commutator|brush|stator|rotor|armature|magnet|electrode|filament|grid|"
    r"bearing|\bgear|\bcam\b|shaft|spring|lever|bolt|screw|\bweld|joint|hinge|latch|strut|bracket|"
    r"fitting|clamp|retainer|roller|pulley|sprocket|detent|"
    r"tank|\bcell\b|batter|\bbus\b|breaker|\bfuse|module|assembly|housing|chamber|nozzle|orifice|"
    r"\btube|pipe|hose|duct|\bline\b|\bvent|\bport\b|screen|membrane|"
    r"heater|radiator|evaporator|sublimat|pump|motor|\bfan\b|blower|injector|bladder|canister|cartridge|wick|"
    r"lamp|\blight|bulb|lens|window|glass|mirror|prism|gauge|indicator|\bmeter\b|dial|stylus|"
    r"rtv|potting|insulation|adhesive|epoxy|teflon|solder|\bfilm\b|coating|lubricant|sealant|"
    r"antenna|transponder|transmitter|receiver|waveguide|"
    r"gyro|accelerometer|gimbal|encoder|thruster|quad|nut|pin\b)"
)
MECHANISM = (
    r"(?i)\b(short|arc|leak|corro|swell|crack|worn|wear|stuck|stick|seiz|broke|broken|ruptur|"
    r"burn|melt|deform|block|clog|contaminat|oversize|misalign|fatigue|intermittent|drift|open\b|"
    r"loose|disconnect|degrad|embrittle|separat|overheat)"
)


def strong_terms(rows: DataFrame, terms: Column, idf: DataFrame, cut: float = L.STRONG_IDF) -> DataFrame:
    """(id, tok, idf) of each row's distinct terms that are rare enough."""
    own = rows.select("id", F.explode(F.array_distinct(terms)).alias("tok"))
    return own.join(idf.select("tok", "idf"), "tok").where(F.col("idf") >= cut).select("id", "tok", "idf")


def components(rows: DataFrame, terms: Column, idf: DataFrame, cut: float = L.STRONG_IDF) -> DataFrame:
    """(id, part, idf, place): part nouns of a cause with an idf of ``cut`` or more, the rarest first.

    Hyphenated terms fall into their pieces of four letters or more, but for whole part
    names; mechanisms and words in -ing or -ed are no parts.
    """
    rare = strong_terms(rows, terms, idf, cut)
    pieces = F.when(
        F.contains("tok", F.lit("-")) & ~F.col("tok").isin(*WHOLE_PARTS),
        F.filter(F.split("tok", "-"), lambda p: F.length(p) >= 4),
    ).otherwise(F.array("tok"))
    parts = rare.select("id", "idf", F.explode(pieces).alias("part")).where(
        F.col("part").rlike(PART) & ~F.col("part").rlike(MECHANISM + "$") & ~F.col("part").rlike("(ing|ed)$")
    )
    best = parts.groupBy("id", "part").agg(F.max("idf").alias("idf"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("idf"), "part")))


def is_named(part: Column, decision: Column, loose: bool = False) -> Column:
    """Whether a decision names a part in the singular or plural, spelt with or without hyphens."""
    stem = F.regexp_replace(part, "s$", "")
    text = F.lower(F.coalesce(decision, F.lit("")))
    exact = F.contains(text, stem) | F.contains(squeezed(decision), squeezed(stem))
    if not loose:
        return exact
    heads = F.filter(F.split(F.lower(part), "[^a-z0-9]+"), lambda h: F.length(h) >= 4)
    return exact | F.exists(heads, lambda h: F.contains(text, h) | (h.endswith("s") & F.contains(text, F.regexp_replace(h, "s$", ""))))


def component_scores(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, primary, any_part, any_loose, coverage): the named parts of each row's cause; rows without parts don't count.

    rows: id, decision, declined (a declined row names nothing); parts: id, part, place.
    """
    said = F.when(F.col("declined"), F.lit("")).otherwise(F.coalesce("decision", F.lit("")))
    each = parts.join(rows.select("id", said.alias("said")), "id").select(
        "id", "place", is_named(F.col("part"), F.col("said")).alias("hit"), is_named(F.col("part"), F.col("said"), True).alias("loose")
    )
    return each.groupBy("id").agg(
        F.bool_or(F.col("hit") & (F.col("place") == 1)).alias("primary"), F.bool_or("hit").alias("any_part"),
        F.bool_or("loose").alias("any_loose"), F.avg(F.col("hit").cast("int")).alias("coverage"),
    )


def subset_report(rows: DataFrame, subsets: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """(subset, n, measures): the means of overlapping subsets; a row counts in each it belongs to, an empty one has n 0."""
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in subsets.items()])
    kept = rows.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("subset"), *[c.cast("double").alias(m) for m, c in measures.items()])
    means = kept.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, subsets))).alias("subset"))
    return every.join(means, "subset", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def term_kind(term: Column) -> Column:
    """where, why, both or other."""
    where, why = term.rlike("(?i)" + L.WHERE), term.rlike("(?i)" + L.WHY)
    return F.when(where & why, "both").when(where, "where").when(why, "why").otherwise("other")


def composition(rows: DataFrame, text: str, by: str) -> DataFrame:
    """Counts of hardware and mechanism words, and how many rows have each, by group."""
    w = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)" + L.WHERE))
    y = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)" + L.WHY))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("where_words"), F.sum(y).alias("why_words"),
        F.count_if(w > 0).alias("has_where"), F.count_if(y > 0).alias("has_why"), F.count_if((w > 0) & (y > 0)).alias("has_both"),
    )


def where_coverage(named: DataFrame) -> DataFrame:
    """Mean, median and hit rate of rows' share of named hardware terms; rows without any don't count.

    named: id, tok, hit boolean.
    """
    share = named.groupBy("id").agg((F.count_if("hit") / F.count(F.lit(1))).alias("share"))
    return share.agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("mean"), F.median("share").alias("median"), F.avg((F.col("share") > 0).cast("int")).alias("hit_rate"))


def chain_profile(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """Each query's chains: how many, mean length, visits, distinct segments and documents, share of single steps.

    paths: query_id, chain, path; segments: ord, source_doc.
    """
    visits = index.sent(paths.select("query_id", "chain", F.size("path").alias("len"), F.explode("path").alias("ord")))
    steps = visits.join(segments.select("ord", "source_doc"), "ord")
    per = steps.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("ord").alias("segments"), F.count_distinct("source_doc").alias("docs")
    )
    chains = paths.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chains"), F.avg(F.size("path")).alias("mean_length"), F.avg((F.size("path") == 1).cast("int")).alias("single")
    )
    return chains.join(per, "query_id").withColumn("redundancy", F.col("visits") / F.col("segments"))


def symptom_node(symptom: Column) -> Column:
    """Symptoms have a key space of their own, whatever their case."""
    return F.concat(F.lit("symptom::"), F.lower(symptom))


def symptom_graph(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments with their symptoms, components, subsystems and links.

    segments: id, subsystem, component, symptoms, links_to.  Parallel edges stay; targets of
    links are nodes though no segment may bear the name, their kind is null.  A name that
    is a segment, a subsystem and a component takes the last of these kinds.
    """
    named = {c: F.col(c).isNotNull() & (F.col(c) != "") for c in ("subsystem", "component")}
    # One row for each edge of a segment, from one pass over the segments.
    edge = lambda on, src, dst, kind: F.when(on, F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))
    segment, sub, comp = F.col("id"), F.col("subsystem"), F.col("component")
    own = F.array(
        edge(named["subsystem"], sub, segment, "has_procedure"), edge(named["component"], comp, segment, "has_procedure"),
        edge(named["subsystem"] & named["component"], sub, comp, "has_component"),
    )
    of_symptoms = F.flatten(F.transform(F.coalesce("symptoms", F.array().cast("array<string>")), lambda x: F.array(
        edge(x.isNotNull(), symptom_node(x), segment, "indicates"), edge(x.isNotNull() & named["subsystem"], symptom_node(x), sub, "associated_with"))))
    of_links = F.transform(F.coalesce("links_to", F.array().cast("array<string>")), lambda x: edge(x.isNotNull(), segment, x, "related_to"))
    kept = F.filter(F.concat(own, of_symptoms, of_links), lambda e: e.isNotNull())
    edges = segments.select(F.explode(kept).alias("e")).select("e.src", "e.dst", "e.kind")
    role = lambda node, n, kind: F.struct(node.alias("node"), F.lit(n).alias("n"), F.lit(kind).alias("kind"))
    roles = F.array(
        role(segment, 1, "procedure"), F.when(named["subsystem"], role(sub, 2, "subsystem")), F.when(named["component"], role(comp, 3, "component"))
    )
    none = F.lit(None).cast("string")
    told = segments.select(F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r")).select("r.node", "r.n", "r.kind", none.alias("text"))
    symptoms = segments.select(F.explode("symptoms").alias("text")).where("text is not null").select(
        symptom_node(F.col("text")).alias("node"), F.lit(4).alias("n"), F.lit("symptom").alias("kind"), "text"
    )
    linked = edges.where("kind = 'related_to'").select(F.col("dst").alias("node"), F.lit(0).alias("n"), none.alias("kind"), none.alias("text"))
    every = told.unionByName(symptoms).unionByName(linked)
    return every.groupBy("node").agg(F.max_by("kind", "n").alias("kind"), F.max("text").alias("text")), edges


def matching_symptoms(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node, overlap) of symptom nodes that share terms with the query, most first by ``place``."""
    own = nodes.where("kind = 'symptom'").select("node", F.explode(F.array_distinct(short_terms(F.col("text")))).alias("tok"))
    asked = queries.select("query_id", F.explode(F.array_distinct(short_terms(F.col("symptom")))).alias("tok"))
    met = asked.join(own, "tok").groupBy("query_id", "node").agg(F.count(F.lit(1)).alias("overlap"))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "node")))


def structural_match(queries: DataFrame, seg_terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, best): the greatest idf-weighted overlap of a query's terms with one segment.

    queries: query_id, terms; seg_terms: ord, terms.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("tok")).join(idf.select("tok", "idf"), "tok")
    held = seg_terms.select("ord", F.explode(F.array_distinct("terms")).alias("tok"))
    return asked.join(held, "tok").groupBy("query_id", "ord").agg(F.sum("idf").alias("s")).groupBy("query_id").agg(F.max("s").alias("best"))


def index_comparison(segments: DataFrame, projections: dict[str, Column], queries: DataFrame, k: int = 8) -> DataFrame:
    """(variant, query_id, ord, rank): the same queries over an index of each projection of the segments.

    Scores are compared to 9 places, so that ties don't hang on the order of a sum.
    """
    # Cleaned once for all projections.
    segments = written(segments.select("ord", *[text.alias(name) for name, text in projections.items()]), "projections")
    out = None
    for name in projections:
        got = index.best(index.build_index(segments, F.col(name)), queries, k).select(F.lit(name).alias("variant"), "query_id", "ord", "rank")
        out = got if out is None else out.unionByName(got)
    return out


def walk_sweep(entries: DataFrame, edges: DataFrame, scores: DataFrame, targets: DataFrame, seg_terms: DataFrame,
               rels: tuple[float, ...], depths: tuple[int, ...]) -> DataFrame:
    """(rel, depth, mean_coverage, n): share of target terms that the walks of each setting reach.

    targets: query_id, terms; seg_terms: ord, terms.  Queries without terms don't count.
    """
    seen = None
    for rel in rels:
        for depth in depths:
            paths = graph.chase(entries, edges, scores, rel, depth).select(F.lit(rel).alias("rel"), F.lit(depth).alias("depth"), "query_id", F.explode("path").alias("ord"))
            seen = paths if seen is None else seen.unionByName(paths)
    seen = index.sent(seen.distinct())
    # The terms of segments that no walk met are never taken.
    own = seg_terms.join(index.sent(seen.select("ord").distinct()), "ord", "left_semi")
    held = own.join(seen, "ord").groupBy("rel", "depth", "query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("have"))
    settings = targets.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(d).alias("depth")) for r in rels for d in depths])).alias("x")).select("x.*")
    cov = F.try_divide(F.size(F.array_intersect("terms", F.coalesce("have", F.array().cast("array<string>")))), F.size(F.array_distinct("terms")))
    asked = targets.crossJoin(F.broadcast(settings)).join(held, ["rel", "depth", "query_id"], "left")
    measured = asked.groupBy("rel", "depth").agg(F.avg(cov).alias("mean_coverage"), F.count(cov).alias("n"))
    return settings.join(measured, ["rel", "depth"], "left").select("rel", "depth", "mean_coverage", F.coalesce("n", F.lit(0)).alias("n"))


def operating_point(rows: DataFrame, flag: str, bad: str) -> DataFrame:
    """Catch rate, false-flag rate and precision of a boolean flag against the bad rows."""
    hit = F.count_if(F.col(flag) & F.col(bad))
    return rows.agg(
        F.try_divide(hit, F.count_if(bad)).alias("catch"),
        F.try_divide(F.count_if(F.col(flag) & ~F.col(bad)), F.count_if(~F.col(bad))).alias("false_flag"),
        F.try_divide(hit, F.count_if(flag)).alias("precision"),
    )


def wrong_subsystem(rows: DataFrame, subsystems: list[str], seed: int = 7) -> DataFrame:
    """``control``: another subsystem than the row's own, chosen by a seeded hash of ``id``."""
    others = F.filter(F.array(*map(F.lit, subsystems)), lambda x: ~F.lower(x).eqNullSafe(F.lower("subsystem")))
    pick = F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest(F.size(others), F.lit(1))).cast("int")
    return rows.withColumn("control", F.get(others, pick))


def turns_report(rows: DataFrame) -> DataFrame:
    """Matched sessions against the human baseline; rows: matched_at, seconds, human_turns, human_seconds."""
    paired = F.col("matched_at").isNotNull() & F.col("human_turns").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("matched_at").alias("matched"), F.avg("matched_at").alias("mean_turns"),
        F.median("matched_at").alias("median_turns"), F.avg("seconds").alias("mean_seconds"),
        F.count_if(paired).alias("paired"), F.count_if(paired & (F.col("matched_at") <= F.col("human_turns"))).alias("no_later"),
        F.avg(F.when(paired, F.col("human_turns"))).alias("human_mean_turns"), F.avg("human_seconds").alias("human_mean_seconds"),
    )


def scope_report(rows: DataFrame, scope: str, declined: str, answered_hit: str) -> DataFrame:
    """Decline and hit rates inside and outside the scope."""
    return rows.groupBy(scope).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(declined).cast("int")).alias("decline_rate"),
        F.try_divide(F.count_if(~F.col(declined) & F.col(answered_hit)), F.count_if(~F.col(declined))).alias("hit_rate"),
    )


def failure_reasons(rows: DataFrame, reason: str) -> DataFrame:
    """How often each reason before the first colon occurs."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.split(reason, ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def usable_baseline(rows: DataFrame, turns: str, seconds: str) -> DataFrame:
    """Rows with a known count of turns or time."""
    return rows.where((F.col(turns) >= 0) | (F.col(seconds) >= 0))


def mentions_any(text: Column, terms: tuple[str, ...]) -> Column:
    return contains_any(F.lower(text), terms)
