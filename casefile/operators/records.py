"""Profiles, accounts, cases and reviews as tables: every change gives the table after it.

A change is a join with the few rows that change; nothing is edited in place, so a table can be rebuilt from the
changes that led to it. Names and keywords are compared without regard to case and outer white space.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.operators.crossref import contained
from casefile.operators.procurement import total


def name_key(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def append_new(rows: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``rows`` and those of ``new`` whose name is not there yet; of new rows with one name the first by all columns. Blank names are no rows."""
    key = name_key(name)
    fresh = new.select(*rows.columns).filter(F.coalesce(key, F.lit("")) != "").withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*rows.columns))
    fresh = fresh.withColumn("_place", first).filter("_place = 1").drop("_place")
    have = rows.select(key.alias("_key")).distinct()
    return rows.unionByName(fresh.join(have, "_key", "left_anti").drop("_key"))


def update(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], blank_keeps: bool = True) -> DataFrame:
    """``rows`` with the columns that ``changes`` (one row per key) gives; nulls, and blanks with ``blank_keeps``, change nothing."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.join(new, F.col(key) == F.col("_key"), "left")

    def value(c: str) -> Column:
        given = F.col(f"_{c}")
        if blank_keeps and dict(rows.dtypes)[c] == "string":
            given = F.when(F.trim(given) != "", given)
        return F.coalesce(given, F.col(c)).alias(c)

    return both.select(*(value(c) if c in columns else F.col(c) for c in rows.columns))


def allowed(changes: DataFrame, owners: DataFrame, key: str, by: str = "by", owner: str = "creator") -> DataFrame:
    """The changes whose author created what they change."""
    own = owners.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"))
    return changes.join(own, (F.col(key) == F.col("_key")) & (F.col(by) == F.col("_owner")), "left_semi")


def map_members(bridge: DataFrame, changes: DataFrame, group: str, member: str, replace: str = "replace") -> DataFrame:
    """A bridge (group, member) after changes (group, member, replace): a group with ``replace`` keeps new members only."""
    cleared = changes.filter(replace).select(group).distinct()
    kept = bridge.select(group, member).join(cleared, group, "left_anti")
    return kept.unionByName(changes.filter(F.col(member).isNotNull()).select(group, member)).distinct()


def unmap_members(bridge: DataFrame, gone: DataFrame, group: str, member: str) -> DataFrame:
    return bridge.join(gone.select(group, member), [group, member], "left_anti")


def link_orphans(accounts: DataFrame, persons: DataFrame, holder: str = "holder", person: str = "person_id", name: str = "name") -> DataFrame:
    """Accounts without a person get that of the holder's name; of persons with one name the least id."""
    known = persons.groupBy(name_key(name).alias("_key")).agg(F.min(person).alias("_person"))
    both = accounts.join(known, name_key(holder) == F.col("_key"), "left")
    return both.select(*(F.coalesce(person, "_person").alias(person) if c == person else F.col(c) for c in accounts.columns))


def review(hits: DataFrame, reviews: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Hits with ``reviewed`` and ``notes`` of their last review (key, at, notes)."""
    last = reviews.groupBy(F.col(key).alias("_key")).agg(F.max_by("notes", at).alias("notes"))
    return hits.join(last, F.col(key) == F.col("_key"), "left").withColumn("reviewed", F.col("_key").isNotNull()).drop("_key")


def acknowledge(alerts: DataFrame, ids: DataFrame, key: str, flag: str = "acknowledged") -> DataFrame:
    done = ids.select(F.col(key).alias("_key")).distinct()
    both = alerts.join(done, F.col(key) == F.col("_key"), "left")
    return both.select(*((F.col(flag) | F.col("_key").isNotNull()).alias(flag) if c == flag else F.col(c) for c in alerts.columns))


def keywords_in_force(requests: DataFrame, sources: Sequence[tuple[DataFrame, str]], own: str | None = None) -> DataFrame:
    """The keywords of each request: those of the first source that names one; later sources are not looked at.

    requests: id and the keys of the sources; sources: (key, keywords) tables with the key's name, from the strongest on; own: a column of the
    request's own keywords, the last resort.
    """
    none = F.array().cast("array<string>")
    out, held = requests, []
    for i, (table, key) in enumerate(sources):
        found = table.select(F.col(key).alias(f"_k{i}"), F.col("keywords").alias(f"_w{i}")).dropDuplicates([f"_k{i}"])
        out = out.join(found, F.col(key) == F.col(f"_k{i}"), "left")
        held.append(F.when(F.col(f"_k{i}").isNotNull(), F.coalesce(f"_w{i}", none)))
    if own:
        held.append(F.col(own))
    return out.select(*requests.columns, F.coalesce(*held, none).alias("keywords_in_force"))


def resolve_profile(requests: DataFrame, profiles: DataFrame, by: Sequence[tuple[str, str]]) -> DataFrame:
    """request columns and profile_id: the first of ``by`` (request column, profile column) that names a profile decides."""
    out, found = requests, []
    for i, (asked, column) in enumerate(by):
        known = profiles.groupBy(name_key(F.col(column).cast("string")).alias(f"_k{i}")).agg(F.min("profile_id").alias(f"_p{i}"))
        out = out.join(known, name_key(F.col(asked).cast("string")) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_p{i}"))
    return out.select(*requests.columns, F.coalesce(*found).alias("profile_id"))


def available_profiles(persons: DataFrame, accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Persons with what their accounts hold, and profiles without a person of their name.

    persons: person_id, name, department; accounts: person_id, bank, n, debit, credit; profiles: profile_id, name, department.
    Returns id, name, department, accounts, transactions, banks (sorted), total_debit, total_credit, has_data.
    """
    held = accounts.groupBy(F.col("person_id").alias("_p")).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("transactions"), F.array_join(F.array_sort(F.collect_set(F.nullif("bank", F.lit("")))), ",").alias("banks"),
        total("debit").alias("total_debit"), total("credit").alias("total_credit"),
    )
    mine = persons.join(held, F.col("person_id") == F.col("_p"), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    amount = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    place = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    mine = mine.select(
        F.col("person_id").alias("id"), "name", place("department", "General Audit"), number("accounts"), number("transactions"), F.coalesce("banks", F.lit("")).alias("banks"), amount("total_debit"), amount("total_credit")
    )
    known = persons.select(name_key("name").alias("_key")).distinct()
    rest = profiles.withColumn("_key", name_key("name")).join(known, "_key", "left_anti")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    rest = rest.select(F.col("profile_id").alias("id"), "name", place("department", "Investigation"), zero.alias("accounts"), zero.alias("transactions"), F.lit("").alias("banks"), none.alias("total_debit"), none.alias("total_credit"))
    return mine.unionByName(rest).withColumn("has_data", F.col("transactions") > 0)


def vault_matches(external: DataFrame, internal: DataFrame) -> DataFrame:
    """Profiles outside a case that its keywords meet: profile_id, name, shared.

    external: profile_id, name, keywords (array); internal: keyword. A profile matches if its name is a keyword, holds one, or it
    shares one of three letters or more. Shared keywords are joined; keywords within names are met over runs of letters.
    """
    words = internal.select(F.lower(F.trim("keyword")).alias("word")).filter(F.length("word") >= 3).distinct()
    each = external.select("profile_id", "name", F.explode_outer("keywords").alias("k"))
    # Exploded rows look as few as the profiles are, so without the hint they pass through the driver.
    shared = each.join(words.hint("merge"), F.lower(F.trim("k")) == F.col("word")).select("profile_id", "name", "word", F.lit(True).alias("own"))
    found = contained(external.select(F.lower("name").alias("text")), words.select(F.col("word").alias("needle")), 3)
    inside = external.join(found.hint("merge"), F.lower("name") == F.col("text")).select("profile_id", "name", F.col("needle").alias("word"), F.lit(False).alias("own"))
    both = shared.unionByName(inside)
    out = both.groupBy("profile_id", "name").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("word")))), ", ").alias("shared"))
    return out.withColumn("shared", F.coalesce(F.nullif("shared", F.lit("")), F.col("name")))


def bridges(edges: DataFrame, targets: DataFrame, documents: DataFrame, parties: DataFrame) -> DataFrame:
    """target, document, party: counterparties that a document ties to a target, by edges (src, dst) of any direction."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    docs = both.join(documents.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    one = docs.join(targets.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("target"), F.col("b").alias("document"))
    two = docs.join(parties.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("party"), F.col("b").alias("document"))
    return one.join(two, "document").filter(F.col("target") != F.col("party")).select("target", "document", "party")


def detections_of(segments: DataFrame, detections: DataFrame, keys: Sequence[str], label: str, order: str, value: str) -> DataFrame:
    """Segments with the first detection of their keys and time label; segments without one keep null."""
    first = detections.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col(label).alias("_label")).agg(F.min_by(value, order).alias(value))
    on = reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, F.col(label) == F.col("_label"))
    return segments.join(first, on, "left").drop("_label", *(f"_{k}" for k in keys))


def columns_of_flow(edges: DataFrame, primary: str) -> DataFrame:
    """name, part of a flow chart: conduits, origins (only send, or the primary one) and beneficiaries.

    edges: sender, conduit (null for a direct one), recipient. Conduits are neither origin nor beneficiary. Without an
    origin the primary name is one, or else the first name.
    """
    conduits = edges.filter(F.coalesce("conduit", F.lit("")) != "").select(F.col("conduit").alias("name")).distinct()
    seen = edges.select(F.col("sender").alias("name"), F.lit(True).alias("sends")).unionByName(edges.select(F.col("recipient").alias("name"), F.lit(False).alias("sends")))
    ends = seen.filter("name is not null").groupBy("name").agg(F.bool_or("sends").alias("sends"), F.bool_or(~F.col("sends")).alias("takes")).join(conduits, "name", "left_anti")
    first = (F.lower("name") == primary.lower()) | (F.col("sends") & ~F.col("takes"))
    ends = ends.select("name", F.when(first, "origin").otherwise("beneficiary").alias("part"))
    names = ends.agg(F.bool_or(F.col("part") == "origin").alias("some"), F.min("name").alias("least"))
    lone = F.lit(primary) if primary else F.col("least")
    missing = names.filter(~F.coalesce("some", F.lit(False))).select(lone.alias("name"), F.lit("origin").alias("part")).filter("name is not null")
    rest = ends.join(missing.select("name"), "name", "left_anti")
    return conduits.withColumn("part", F.lit("conduit")).unionByName(rest).unionByName(missing)


def clean_edges(edges: DataFrame, entities: DataFrame, stop_names: Sequence[str], derived: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without stop names and derived relations: (entities, edges)."""
    bad = entities.filter(name_key("name").isin(*[s.strip().lower() for s in stop_names])).select("id")
    left = edges.filter(~F.coalesce(F.col("relation").isin(*derived), F.lit(False)))
    for end in ("src", "dst"):
        left = left.join(bad.select(F.col("id").alias(end)), end, "left_anti")
    return entities.join(bad, "id", "left_anti"), left.select(*edges.columns)


def dossier(direct: DataFrame, hops: DataFrame) -> DataFrame:
    """Findings to keep: sender, recipient, kind, amount, risk of direct matches (method) and conduits (retained_pct)."""
    one = direct.select("sender", "recipient", F.lit("DIRECT").alias("kind"), "amount", F.when(F.col("method").contains("FUZZY"), 60).otherwise(40).alias("risk"))
    two = hops.select("sender", "recipient", F.lit("CONDUIT").alias("kind"), "amount", F.when(F.col("retained_pct") > 10, 85).otherwise(75).alias("risk"))
    return one.unionByName(two)


def findings_of(producers: Sequence[tuple[DataFrame, str, str, float, int]]) -> DataFrame:
    """All modules' findings as edges with evidence: src, dst, relation, module, evidence, weight, confidence, risk.

    producers: (src, dst, evidence, weight) tables with their relation, module, confidence and risk. One plan over all of them; what
    has an end missing, or both the same, is no edge.
    """
    parts = [
        df.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), F.lit(relation).alias("relation"), F.lit(module).alias("module"), F.col("evidence").cast("string").alias("evidence"), F.col("weight").cast("double").alias("weight"), F.lit(confidence).alias("confidence"), F.lit(risk).alias("risk"))
        for df, relation, module, confidence, risk in producers
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.filter((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "") & (F.lower("src") != F.lower("dst")))
