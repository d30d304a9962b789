"""The relationship graph: edges with evidence, neighbourhoods, paths, cycles, merged edges, alerts, resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.functions.text import ADDRESS, canonical_name
from casefile.operators.linking import groups, similar_pairs
from casefile.operators.procurement import total


# Relations and modules as findings name them.
VENDOR_FLOWS = ("VENDOR_KICKBACK_RECEIVED", "VENDOR_PAYOUT_DETECTED")
KINSHIP, ROLES = ("SPOUSE", "KINSHIP", "NOMINEE"), ("EMPLOYEE_OF", "ROLE_IN")
BANK_MODULES, TRAIL_MODULES = ("q_bank", "bank", "q_ledger", "ledger"), ("q_trail", "trail")
FUNDS_OR_MAIL = ("TRANSFERRED_FUNDS", "EMAILED")
NEAR_RELATIONS = ("CONDUIT_TO", "EMPLOYEE_VENDOR_NEXUS", "PARTNER", "SPOUSE", "WIFE", "NOMINEE")


def upsert_edges(findings: DataFrame, keys: Sequence[str], evidence: str, weight: str, confidence: str) -> DataFrame:
    """Findings to edges: an evidence record counts once, weights add up, the best confidence stays."""
    once = findings.groupBy(*keys, evidence).agg(F.max(weight).alias(weight), F.max(confidence).alias(confidence))
    return once.groupBy(*keys).agg(total(weight).alias("weight"), F.max(confidence).alias("confidence"), F.count(F.lit(1)).alias("evidence"))


def neighbourhood(edges: DataFrame, src: str, dst: str, start: str, hops: int, confidence: str | None = None, least: float = 0.5) -> DataFrame:
    """name, hop of everything within ``hops`` of ``start``, direction ignored; a frontier join per hop.

    With ``confidence``, only edges from ``least`` on are walked.
    """
    if confidence:
        edges = edges.filter(F.col(confidence) >= least)
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "name string, hop int")
    front = seen
    for h in range(1, hops + 1):
        front = front.join(both, F.col("name") == F.col("a")).select(F.col("b").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, src: str, dst: str, start: str, end: str, hops: int, edge: Column | None = None) -> DataFrame:
    """All simple paths of at most ``hops`` edges: path, length.

    With ``edge``, an id, edges are walked both ways and parallel ones make paths of their own: path, length, edges.
    """
    if edge is not None:
        return _paths_both_ways(edges, src, dst, start, end, hops, edge)
    step = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    walk = edges.sparkSession.createDataFrame([([start],)], "path array<string>")
    found = None
    for h in range(1, hops + 1):
        walk = walk.join(step, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"))
        done = walk.filter(F.element_at("path", -1) == end).select(F.array_join("path", ">").alias("path"), F.lit(h).alias("length"))
        found = done if found is None else found.unionByName(done)
        walk = walk.filter(F.element_at("path", -1) != end)
    return found


def _paths_both_ways(edges: DataFrame, src: str, dst: str, start: str, end: str, hops: int, edge: Column) -> DataFrame:
    each = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), edge.cast("string").alias("id")).filter("a <> b")
    step = each.unionByName(each.select(F.col("b").alias("a"), F.col("a").alias("b"), "id"))
    walk = edges.sparkSession.createDataFrame([([start], [])], "path array<string>, ids array<string>")
    found = None
    for h in range(1, hops + 1):
        walk = walk.join(step, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        walk = walk.select(F.array_append("path", F.col("b")).alias("path"), F.array_append("ids", F.col("id")).alias("ids"))
        done = walk.filter(F.element_at("path", -1) == end).select(F.array_join("path", ">").alias("path"), F.lit(h).alias("length"), F.col("ids").alias("edges"))
        found = done if found is None else found.unionByName(done)
        walk = walk.filter(F.element_at("path", -1) != end)
    return found


def cycles(edges: DataFrame, src: str, dst: str, longest: int = 5) -> DataFrame:
    """One cycle per set of nodes, of 2 to ``longest`` nodes: members (sorted), cycle (its least spelling), nodes."""
    step = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct()
    walk = step.filter("a < b").select(F.array("a", "b").alias("path"))
    found = None
    for n in range(2, longest + 1):
        closed = walk.join(step, (F.element_at("path", -1) == F.col("a")) & (F.element_at("path", 1) == F.col("b"))).select("path")
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            # A cycle is walked from its least member only.
            walk = walk.join(step, F.element_at("path", -1) == F.col("a")).filter((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b")))
            walk = walk.select(F.array_append("path", F.col("b")).alias("path"))
    out = found.groupBy(F.array_join(F.array_sort("path"), ",").alias("members")).agg(F.min(F.array_join("path", ">")).alias("cycle"), F.first(F.size("path")).alias("nodes"))
    return out


def merge_parallel(edges: DataFrame, src: str, dst: str, weight: str, count: str) -> DataFrame:
    """Edges between two nodes as one: dominant direction by weight, sums, both-ways mark."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    out = edges.groupBy(a.alias("a"), b.alias("b")).agg(
        F.max_by(F.concat_ws(">", src, dst), F.struct(F.col(weight), F.col(count), F.col(src))).alias("dominant"),
        total(weight).alias("weight"), F.sum(count).alias("evidence"), F.count_distinct(src).alias("_ways"),
    )
    return out.withColumn("both_ways", F.col("_ways") > 1).drop("_ways")


def merge_edges(edges: DataFrame) -> DataFrame:
    """All edges between two nodes as one edge with the rank of relations, without counting one flow twice.

    edges: edge_id, src, dst, relation, label, module, weight, confidence, evidence, layering (boolean). Returns a, b (the
    pair in order), src, dst, relation, label of the dominant edge, weight, confidence, evidence, layering, both_ways, links,
    modules. An edge dominates by vendor flow, kinship, role, layering, weight, confidence and evidence, in this order; ties
    go to the first edge_id. The weight is that of bank and ledger or of the trail, whichever is more, as both tell of the same flows; of
    other modules the sum where neither has any. Rows with a null end are left out.
    """
    rel = F.coalesce("relation", F.lit(""))
    flag = lambda names: rel.isin(*names).cast("int")
    zero = F.lit(0.0)
    rank = F.struct(
        flag(VENDOR_FLOWS).alias("vendor"), flag(KINSHIP).alias("kin"), flag(ROLES).alias("role"), F.coalesce("layering", F.lit(False)).cast("int").alias("rapid"),
        F.coalesce("weight", zero).alias("weight"), F.coalesce("confidence", zero).alias("confidence"), F.coalesce("evidence", F.lit(0)).alias("evidence"),
    )
    module = F.lower(F.coalesce("module", F.lit("")))
    part = lambda test: total(F.when(test, F.col("weight")))
    rows = edges.filter("src is not null and dst is not null").withColumn("_rank", rank)
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    top = F.max_by(F.struct("src", "dst", "relation", "label"), F.struct("_rank", (-F.col("edge_id")).alias("first")))
    bank, trail = module.isin(*BANK_MODULES), module.isin(*TRAIL_MODULES)
    out = rows.groupBy(*pair).agg(
        top.alias("top"), part(bank).alias("_bank"), part(trail).alias("_trail"), part(~bank & ~trail).alias("_other"), F.max("weight").alias("_most"),
        F.max("confidence").alias("confidence"), F.sum("evidence").alias("evidence"), F.max("layering").alias("layering"), (F.count_distinct("src") > 1).alias("both_ways"),
        F.count(F.lit(1)).alias("links"), F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"),
    )
    b, t, o = (F.coalesce(c, zero) for c in ("_bank", "_trail", "_other"))
    weight = F.when((b > 0) & (t > 0), F.greatest(b, t)).when((b > 0) | (t > 0), b + t).when(o != 0, o).otherwise(F.coalesce("_most", zero))
    name = F.coalesce(F.nullif("top.label", F.lit("")), "top.relation", F.lit("Connected"))
    label = F.when((F.col("links") == 1) | F.col("top.relation").isin(*VENDOR_FLOWS), name).when(F.col("both_ways"), F.concat(name, F.lit(" ⇄ ("), F.col("links"), F.lit(" Links)"))).otherwise(F.concat(name, F.lit(" + "), F.col("links") - 1, F.lit(" Links")))
    weight = F.when(F.col("links") == 1, F.coalesce("_most", zero)).otherwise(weight)
    return out.select("a", "b", "top.src", "top.dst", "top.relation", label.alias("label"), weight.alias("weight"), "confidence", "evidence", "layering", "both_ways", "links", "modules")


def unordered_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.agg(F.count_distinct(F.least(src, dst), F.greatest(src, dst)).alias("pairs"), F.count(F.lit(1)).alias("edges"))


def module_alerts(evidence: DataFrame, entity: str, module: str, least: int = 3) -> DataFrame:
    """Entities with evidence from at least ``least`` modules: modules, level, risk."""
    out = evidence.groupBy(entity).agg(F.count_distinct(module).alias("modules"), F.array_join(F.array_sort(F.collect_set(module)), ",").alias("which"))
    return out.filter(F.col("modules") >= least).withColumn("level", F.lit("HIGH")).withColumn("risk", F.lit(85))


def both_ends(edges: DataFrame) -> DataFrame:
    """Every edge from each of its ends: entity, other, and the edge's columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("entity"), F.col("dst").alias("other"), *rest)
    return out.unionByName(edges.select(F.col("dst").alias("entity"), F.col("src").alias("other"), *rest))


def alerts(entities: DataFrame, edges: DataFrame, substantiated: DataFrame, least: int = 3, acknowledged: DataFrame | None = None) -> DataFrame:
    """entity, title, level, risk, related: what an entity's relations give rise to, a title once.

    entities: id, name, type; edges: src, dst, relation, module; substantiated: name. Rules: evidence in at least ``least``
    modules (HIGH, 85); an employee's funds or mails to a vendor, outgoing edges only (CRITICAL, 95); a neighbour whose name is one of a
    substantiated profile, without regard to case (CRITICAL, 95). acknowledged: open alerts (entity, title) that are not raised again.
    """
    who = lambda p: entities.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("type").alias(f"{p}_type"))
    ends = both_ends(edges.select("src", "dst", "relation", "module"))
    none = F.lit(None).cast("string")
    many = module_alerts(ends, "entity", "module", least).join(who("own"), F.col("entity") == F.col("own_id"))
    many = many.select("entity", F.concat(F.lit("Multi-Tool Cross Correlation: "), "own_name").alias("title"), "level", "risk", none.alias("related"))
    pay = edges.filter(F.col("relation").isin(*FUNDS_OR_MAIL)).join(who("own"), F.col("src") == F.col("own_id")).join(who("to"), F.col("dst") == F.col("to_id"))
    pay = pay.filter((F.col("own_type") == "EMPLOYEE") & (F.col("to_type") == "VENDOR"))
    pair = lambda start, a, b: F.concat(F.lit(start), F.col(a), F.lit(" <-> "), F.col(b)).alias("title")
    critical = (F.lit("CRITICAL").alias("level"), F.lit(95).alias("risk"))
    pay = pay.select(F.col("src").alias("entity"), pair("Employee-Vendor Nexus: ", "own_name", "to_name"), *critical, F.col("to_id").cast("string").alias("related"))
    known = substantiated.select(F.col("name").alias("k_name"), F.lower(F.trim("name")).alias("k_key")).dropDuplicates(["k_key"])
    near = ends.select("entity", "other").distinct().join(who("to"), F.col("other") == F.col("to_id")).join(known, F.lower(F.trim("to_name")) == F.col("k_key")).join(who("own"), F.col("entity") == F.col("own_id"))
    near = near.select("entity", pair("Nexus with Substantiated Target: ", "own_name", "k_name"), *critical, F.col("to_id").cast("string").alias("related"))
    out = many.unionByName(pay).unionByName(near).groupBy("entity", "title").agg(F.first("level").alias("level"), F.max("risk").alias("risk"), F.min("related").alias("related"))
    if acknowledged is not None:
        out = out.join(acknowledged.select("entity", "title"), ["entity", "title"], "left_anti")
    return out


def raised_risk(entities: DataFrame, edges: DataFrame, found: DataFrame, large: float = 500_000.0) -> DataFrame:
    """id, risk: an entity's own risk, its highest alert's and the floors of its relations, whichever is most.

    entities: id, risk, target (boolean); edges: src, dst, relation, weight, layering; found: alerts (entity, risk).
    """
    rel = F.upper(F.coalesce("relation", F.lit("")))
    rapid = (rel == "RAPID_LAYERING") | F.coalesce("layering", F.lit(False))
    kind = F.when(rapid, 3).when(rel.isin(*NEAR_RELATIONS), 2).when((rel == "TRANSFERRED_FUNDS") & (F.col("weight") >= large), 1).otherwise(0)
    floors = both_ends(edges.select("src", "dst", kind.alias("kind"))).groupBy("entity").agg(F.max("kind").alias("kind"))
    top = found.groupBy(F.col("entity").alias("a_entity")).agg(F.max("risk").alias("alert"))
    out = entities.join(floors, F.col("id") == F.col("entity"), "left").join(top, F.col("id") == F.col("a_entity"), "left")
    target = F.coalesce("target", F.lit(False))
    floor = F.when(F.col("kind") == 3, F.when(target, 80).otherwise(72)).when(F.col("kind") == 2, F.when(target, 75).otherwise(65)).when(F.col("kind") == 1, F.when(target, 70).otherwise(60)).otherwise(0)
    return out.select("id", F.greatest(F.coalesce("risk", F.lit(0)), F.coalesce("alert", F.lit(0)), floor).alias("risk"))


def raise_vendor_flows(rows: DataFrame, matches: DataFrame, row: str) -> DataFrame:
    """Transactions with the risk of money from or to vendors: at least 95 in, 90 out, level High, the reason added.

    rows: ``row``, direction, risk_score, risk_level, reason; matches: ``row``, vendor_name, attributes (what they share), any
    number per row; the first by vendor name gives the reason.
    """
    first = matches.groupBy(F.col(row).alias("_row")).agg(F.min(F.struct("vendor_name", "attributes")).alias("v"))
    out = rows.join(first, F.col(row) == F.col("_row"), "left")
    into = F.col("direction") == "IN"
    floor = F.when(into, 95).otherwise(90)
    said = F.concat(F.when(into, "Suspected Vendor Kickback from '").otherwise("Undisclosed Vendor Payment to '"), F.col("v.vendor_name"), F.lit("' ("), F.col("v.attributes"), F.lit(")"))
    hit = F.col("v").isNotNull() & ((F.col("risk_score") < floor) | (F.coalesce("risk_level", F.lit("")) != "High"))
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat_ws(" | ", "reason", said)).otherwise(said)
    names = [c for c in rows.columns if c not in ("risk_score", "risk_level", "reason")]
    return out.select(
        *names, F.when(hit, F.greatest("risk_score", floor)).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(hit, "High").otherwise(F.col("risk_level")).alias("risk_level"), F.when(hit, reason).otherwise(F.col("reason")).alias("reason"),
    )


#: Members of a set of keywords in one block, so a row opens to at most a million pairs or so.
MEMBERS = 1000
#: Profiles up to which their ids, in blocks, are sent to all workers (some 50 MB); beyond, blocks are shuffled for each pair of sets.
IDS_SENT = 6_000_000


def keyword_nexus(profiles: DataFrame, id_col: str, keywords: str) -> DataFrame:
    """Pairs of profiles that share keywords: a < b, shared, list. Keywords are joined, profiles are not compared.

    A row per pair is the result, so a keyword of m profiles gives m * m / 2; ``keyword_members`` has a row per member. Profiles with
    the same keywords are one set: sets are compared, and their pairs are opened by blocks of members, so no pair is shuffled.
    """
    kept = F.array_sort(F.array_distinct(F.filter(keywords, lambda k: F.length(k) >= 3)))
    held = profiles.select(F.col(id_col).alias("id"), kept.alias("ks")).filter(F.size("ks") > 0)
    # A profile in several rows holds the keywords of all.
    held = held.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ks")))).alias("ks"))
    sets = held.groupBy("ks").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select("ks", F.explode("ks").alias("k"))
    # The pair of two sets is met under each common keyword, and counts under the least.
    left, right = each.select(F.col("ks").alias("xs"), "k"), each.select(F.col("ks").alias("ys"), "k")
    both = F.array_intersect("xs", "ys")
    met = left.join(right.hint("merge"), "k").filter((F.col("xs") <= F.col("ys")) & (F.col("k") == F.array_min(both)))
    met = met.select("xs", "ys", F.size(both).cast("long").alias("shared"), F.array_join(F.array_sort(both), ",").alias("keywords"))
    dealt = held.join(sets.hint("merge"), "ks").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)))
    blocks = dealt.groupBy("ks", "block").agg(F.collect_list("id").alias("ids"))
    one, two = (blocks.select(F.col("ks").alias(f"{s}s"), F.col("block").alias(f"{s}_block"), F.col("ids").alias(f"{s}_ids")) for s in "xy")
    met = met.join(one.drop("x_ids").hint("merge"), "xs").join(two.drop("y_ids").hint("merge"), "ys").filter("xs < ys OR x_block <= y_block")
    # Dealt out evenly, before ids come: a row opens to as many pairs as its blocks hold, and no block of ids is shuffled for each pair of sets.
    met = met.repartition(4 * met.sparkSession.sparkContext.defaultParallelism, F.xxhash64("xs", "ys", "x_block", "y_block")).withColumn("same", F.expr("xs = ys AND x_block = y_block"))
    sent = "broadcast" if profiles.count() <= IDS_SENT else "merge"
    met = met.join(one.hint(sent), ["xs", "x_block"]).join(two.hint(sent), ["ys", "y_block"])
    pairs = met.withColumn("x", F.explode("x_ids")).withColumn("y", F.explode("y_ids")).filter("NOT same OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "keywords")


def keyword_members(profiles: DataFrame, id_col: str, keywords: str, least: int = 2) -> DataFrame:
    """k, id, members: profiles under each keyword that at least ``least`` share; as many rows as there are keywords given."""
    each = profiles.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(keywords)).alias("k")).filter(F.length("k") >= 3)
    sizes = each.groupBy(F.col("k").alias("s_k")).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)
    return each.join(sizes, F.col("k") == F.col("s_k")).select("k", "id", "members")


def vendor_nexus(rows: DataFrame, vendors: DataFrame, narration_key: Column, vendor_key: Column, keep: Sequence[str], vendor_cols: Sequence[str], direction: Column, amount: Column) -> DataFrame:
    """Flows between transactions and vendors that share a key: count, volume by direction."""
    r = rows.withColumn("_k", narration_key).withColumn("direction", direction).withColumn("_amount", amount)
    v = vendors.withColumn("_k", vendor_key).select("_k", *vendor_cols)
    return r.join(v, "_k").groupBy(*vendor_cols, *keep, "direction").agg(F.count(F.lit(1)).alias("n"), total("_amount").alias("volume"))


def resolve(names: DataFrame, id_col: str, name: str, least: int = 85) -> DataFrame:
    """id, key, entity: names whose canonical keys are equal or, without blanks, similar by ``least`` percent or more are one entity.

    All similar pairs of keys count and their groups are whole, however the chain of names runs; the entity is the least key of its group. A
    name without a letter or digit is an entity of its own (an empty key).
    """
    keyed = names.select(id_col, canonical_name(F.col(name)).alias("key"))
    packed = F.replace("key", F.lit(" "), F.lit(""))
    forms = keyed.select("key", packed.alias("form")).distinct().filter("form <> ''")
    roots = groups(similar_pairs(forms, "form", least)).select(F.col("node").alias("r_form"), "root")
    forms = forms.join(roots, F.col("form") == F.col("r_form"), "left").withColumn("root", F.coalesce("root", "form"))
    entity = forms.groupBy("root").agg(F.min("key").alias("entity"))
    found = forms.join(entity, "root").select(F.col("key").alias("e_key"), "entity")
    return keyed.join(found, F.col("key") == F.col("e_key"), "left").select(id_col, "key", F.coalesce("entity", "key").alias("entity"))


def extract_entities(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, kind, entity, hits of mail addresses, phone numbers, payment addresses and links in texts."""
    patterns = {
        "EMAIL": ADDRESS,
        "PHONE": r"\b[0-9]{10}\b",
        "URL": r"https?://[A-Za-z0-9./_-]+",
    }

    def all_of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 0), lambda e: F.struct(F.lit(kind).alias("kind"), F.lower(e).alias("entity")))

    found = [all_of(kind, pattern) for kind, pattern in patterns.items()]
    each = docs.select(id_col, F.explode(F.concat(*found)).alias("e")).select(id_col, "e.kind", "e.entity")
    return each.groupBy(id_col, "kind", "entity").agg(F.count(F.lit(1)).alias("hits"))


def sankey(edges: DataFrame, src: str, dst: str, amount: str) -> DataFrame:
    """source, target, value with dense node numbers by name; the nodes of a drawing are few and numbered in one task."""
    w = Window.orderBy("name")
    nodes = edges.select(F.col(src).alias("name")).unionByName(edges.select(F.col(dst).alias("name"))).distinct().withColumn("node", F.row_number().over(w) - 1)
    a, b = nodes.select(F.col("name").alias("_a"), F.col("node").alias("source")), nodes.select(F.col("name").alias("_b"), F.col("node").alias("target"))
    return edges.join(a, F.col(src) == F.col("_a")).join(b, F.col(dst) == F.col("_b")).select("source", "target", F.col(amount).alias("value"))
