"""Cases and profiles: keywords, corroboration, suggestions, statements of one side, inference, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.operators.procurement import total

# Titles and legal words that are no part of a name.
NO_NAME_TOKENS = ("mr", "mrs", "ms", "shri", "smt", "dr", "and", "the", "ltd", "pvt", "inc", "corp")


def normalise_keywords(rows: DataFrame, id_col: str, raw: str) -> DataFrame:
    """id, keywords: a JSON list or a comma list, trimmed; of spellings that differ in case the first stays."""
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.split(F.coalesce(F.col(raw), F.lit("")), ","))
    words = F.filter(F.transform(listed, lambda k: F.trim(k)), lambda k: F.coalesce(k, F.lit("")) != "")
    lows = F.transform(words, F.lower)
    first = F.filter(F.transform(words, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: F.array_position(lows, F.lower(x["k"])) == x["i"] + 1)
    return rows.select(id_col, F.transform(first, lambda x: x["k"]).alias("keywords"))


def add_keywords(profiles: DataFrame, new: DataFrame, key: str, keywords: str = "keywords") -> DataFrame:
    """Profiles with the new keywords (key, keyword) behind their own, those they have in any case left out."""
    fresh = new.groupBy(key).agg(F.array_sort(F.collect_set(F.trim("keyword"))).alias("_new")).withColumnRenamed(key, "_key")
    both = profiles.join(fresh, F.col(key) == F.col("_key"), "left")
    own = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    lows = F.transform(own, F.lower)
    extra = F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda k: ~F.array_contains(lows, F.lower(k)))
    return both.withColumn(keywords, F.concat(own, extra)).drop("_key", "_new")


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[\s._-]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*NO_NAME_TOKENS))


def one_sided(rows: DataFrame, names: DataFrame, name: str, party: str, keep: Sequence[str], debit: str = "debit", credit: str = "credit", least: float = 1000.0) -> DataFrame:
    """Transactions that mention a person without a statement by a token of the name: keep, person, direction, amount.

    Both sides are broken into tokens and joined on them, so names are not held against every row.
    """
    tokens = names.select(F.col(name).alias("person"), F.explode(F.array_distinct(name_tokens(F.col(name)))).alias("token"))
    amount = F.greatest(debit, credit)
    said = rows.filter(amount >= least).select(*keep, F.when(F.col(credit) > 0, "IN").otherwise("OUT").alias("direction"), amount.alias("amount"), F.explode(F.array_distinct(F.split(F.lower(party), r"[\s._-]+"))).alias("token"))
    return said.join(tokens, "token").drop("token").distinct()


def corroborate(parties: DataFrame, party: str, sources: dict[str, tuple[DataFrame, Column]], least: int = 2) -> DataFrame:
    """party, sources, badge: in how many kinds of evidence a party is named; each source gives its named parties."""
    named = [df.select(F.upper(F.trim(who)).alias("_who")).distinct().withColumn("source", F.lit(n)) for n, (df, who) in sources.items()]
    all_named = reduce(DataFrame.unionByName, named)
    who = parties.select(F.col(party)).distinct().withColumn("_key", F.upper(F.trim(F.col(party))))
    found = who.join(all_named, F.col("_key") == F.col("_who")).groupBy(party).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n"))
    return found.withColumn("badge", F.col("n") >= least)


def suggest(direct: DataFrame, layering: DataFrame, hops: DataFrame, party: str, amount: str) -> DataFrame:
    """Parties to look at: the strongest kind counts (conduit, layering, direct), volumes of direct repeats add up."""
    kinds = [(hops, "CONDUIT", 85, 0), (layering, "LAYERING", 75, 1), (direct, "DIRECT", 60, 2)]
    rows = reduce(DataFrame.unionByName, [df.groupBy(party).agg(total(amount).alias("volume")).withColumns({"kind": F.lit(k), "score": F.lit(s), "_p": F.lit(p)}) for df, k, s, p in kinds])
    w = Window.partitionBy(party).orderBy("_p")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_p")


def infer(rows: DataFrame, keyword: str, snippet: str) -> DataFrame:
    """category and inference of a snippet: kinship from fields in pipes, employment, a contact, a relative in words."""
    s = F.trim(F.coalesce(F.col(snippet), F.lit("")))
    field = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(s, rf"(?i)(?:^|[|\n])\s*{n}\s*:\s*([^|\n]*)", 1)), F.lit("")) for n in names])
    piped = s.contains("|") & s.contains(":")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    employee, nominee = plain(field("employee", "emp_name", "name", "insured")), plain(field("nominee", "beneficiary"))
    relation, department, role = field("relationship", "relation"), field("department", "dept", "division"), field("designation", "role", "title")
    kin_words = r"(?i)\b(wife|husband|spouse|father|mother|brother|sister|son|daughter)\s+of\s+([A-Z][\w.]*(?:\s+[A-Z][\w.]*)*)"
    contact = r"(?i)(?:point of contact|contact person|poc)\s*[:\-]\s*([A-Z][\w.]*(?:\s+[A-Z][\w.]*)*)"
    kin = F.concat_ws(" ", F.coalesce(nominee, F.col(keyword)), F.lit("is"), F.coalesce(relation, F.lit("nominee")), F.lit("of"), F.coalesce(employee, F.lit("an employee")))
    job = F.concat_ws(", ", F.coalesce(employee, F.col(keyword)), role, department)
    is_kin, is_job = piped & (relation.isNotNull() | nominee.isNotNull()), piped & (department.isNotNull() | role.isNotNull())
    category = F.when(is_kin, "KINSHIP").when(is_job, "EMPLOYMENT").when(s.rlike(contact), "VENDOR").when(s.rlike(kin_words), "KINSHIP")
    text = F.when(is_kin, kin).when(is_job, job).when(s.rlike(contact), F.concat(F.lit("Contact: "), F.regexp_extract(s, contact, 1)))
    text = text.when(s.rlike(kin_words), F.concat(F.col(keyword), F.lit(" is "), F.lower(F.regexp_extract(s, kin_words, 1)), F.lit(" of "), F.regexp_extract(s, kin_words, 2)))
    return rows.withColumn("category", F.coalesce(category, F.lit(""))).withColumn("inference", F.coalesce(text, F.lit("")))


def findings_to_edges(findings: DataFrame, primary: str, secondaries: str, kind: str, outward: str, weight: str) -> DataFrame:
    """A finding names one entity and others: an edge for each, out of or into the first."""
    each = findings.select(F.col(primary).alias("_p"), F.explode(secondaries).alias("_s"), F.col(kind).alias("type"), F.col(outward).alias("_o"), F.col(weight).alias("weight"))
    src, dst = F.when(F.col("_o"), F.col("_p")).otherwise(F.col("_s")), F.when(F.col("_o"), F.col("_s")).otherwise(F.col("_p"))
    return each.select(src.alias("src"), dst.alias("dst"), "type", "weight").filter("src <> dst")


def timeline(events: DataFrame, keys: Sequence[str], n: int = 100) -> DataFrame:
    """Distinct events, the newest n."""
    return events.select(*keys).distinct().orderBy(*[F.desc(k) for k in keys]).limit(n)


def next_number(cases: DataFrame, name: str, year: int) -> DataFrame:
    """The next case name of a year, YYYY-WB-NN."""
    tail = F.regexp_extract(name, rf"^{year}-WB-(\d+)$", 1).try_cast("int")
    return cases.agg(F.concat(F.lit(f"{year}-WB-"), F.lpad((F.coalesce(F.max(tail), F.lit(0)) + 1).cast("string"), 2, "0")).alias("name"))


def back_fill(profiles: DataFrame, name: str, found: dict[str, DataFrame]) -> DataFrame:
    """Profiles for names that evidence holds and no profile does: name, category by the first source in order."""
    rows = reduce(DataFrame.unionByName, [df.select(F.trim(F.col(name)).alias(name)).withColumns({"category": F.lit(k), "_p": F.lit(i)}) for i, (k, df) in enumerate(found.items())])
    rows = rows.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(F.lower(name).alias("_low")).agg(F.min(F.struct("_p", name, "category")).alias("f"))
    known = profiles.select(F.lower(F.trim(F.col(name))).alias("_low"))
    return rows.join(known, "_low", "left_anti").select(F.col(f"f.{name}").alias(name), F.col("f.category").alias("category"))


def delete_with_children(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys of ``gone``."""
    k = gone.select(F.col(key)).distinct()
    return parents.join(k, key, "left_anti"), children.join(k, key, "left_anti")


def graph_of(edges: DataFrame, targets: DataFrame, src: str, dst: str, name: str, risk: DataFrame, most: int = 120) -> DataFrame:
    """Nodes of a case graph: targets, their neighbours and the neighbours' neighbours; targets first, then by risk.

    The limit on nodes is the feature: a drawing holds so many.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct()
    t = targets.select(F.col(name).alias("node")).distinct()
    near = t.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
    far = near.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
    ring = reduce(DataFrame.unionByName, [df.withColumn("ring", F.lit(i)) for i, df in enumerate((t, near, far))]).groupBy("node").agg(F.min("ring").alias("ring"))
    scored = ring.join(risk.select(F.col(name).alias("node"), "risk"), "node", "left").withColumn("risk", F.coalesce("risk", F.lit(0)))
    return scored.orderBy(F.asc(F.when(F.col("ring") == 0, 0).otherwise(1)), F.desc("risk"), "node").limit(most)


def module_stats(modules: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """module, n, last_day for each table of evidence; one small aggregate per table."""
    parts = []
    for name, (df, date) in modules.items():
        last = F.date_format(F.max(date), "yyyy-MM-dd") if date else F.lit(None).cast("string")
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), last.alias("last_day")).withColumn("module", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("module", "n", "last_day")
