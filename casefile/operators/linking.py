"""Similar keys without comparing all of them, and groups of what is linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions.text import canonical_name, indel_ratio
from casefile.operators.entities import identifier as entity_identifier
from casefile.operators.fuzzynames import similar_names, word_set_ratio
from casefile.session import Work, spread


def most_apart(n: Column, percent: int) -> Column:
    """How many letters a key of length ``n`` may lose and gain towards a longer one that is still similar enough."""
    longest = F.floor(n * (200 - percent) / percent)
    return F.floor((100 - percent) * (n + longest) / 100).cast("int")


def cut(n: Column, i: Column, parts: Column) -> Column:
    """Where the i-th of ``parts`` pieces of a key of length ``n`` starts, from 0."""
    return F.call_function("div", i * n, parts).cast("int")


def similar_pairs(keys: DataFrame, key: str, percent: int = 85) -> DataFrame:
    """(a, b), a < b: all pairs of keys whose ratio 200 * LCS / (length a + length b) is at least ``percent``.

    No pair is lost: of two such keys the longer comes from the shorter by d insertions and deletions at most, so of d + 1 pieces of the
    shorter one stands in the longer unchanged, at most d places away. Keys are joined over such pieces and
    what meets is compared. Keys are to be distinct names; null and empty ones are in no pair.
    """
    base = keys.select(F.col(key).alias("k"), F.length(key).alias("n")).filter("n > 0").distinct()
    parts = lambda n: most_apart(n, percent) + 1
    # The shorter side: its pieces.
    short = base.select("k", "n", F.explode(F.sequence(F.lit(0), most_apart(F.col("n"), percent))).alias("i"))
    start = cut(F.col("n"), F.col("i"), parts(F.col("n")))
    size = cut(F.col("n"), F.col("i") + 1, parts(F.col("n"))) - start
    short = short.select(F.col("k").alias("a"), F.col("n").alias("m"), "i", F.substring("k", start + 1, size).alias("piece"))
    # The longer side: for each length of a shorter one, what stands where the piece may have moved to.
    least = F.ceil(F.col("n") * percent / (200 - percent)).cast("int")
    wide = base.select("k", "n", F.explode(F.sequence(F.greatest(F.lit(1), least), F.col("n"))).alias("m"))
    wide = wide.select("k", "n", "m", F.explode(F.sequence(F.lit(0), most_apart(F.col("m"), percent))).alias("i"))
    at = cut(F.col("m"), F.col("i"), parts(F.col("m")))
    size = cut(F.col("m"), F.col("i") + 1, parts(F.col("m"))) - at
    reach = most_apart(F.col("m"), percent)
    low, high = F.greatest(F.lit(0), at - reach), F.least(F.col("n") - size, at + reach)
    wide = wide.withColumn("size", size).withColumn("low", low).withColumn("high", high).filter("low <= high")
    wide = wide.select(F.col("k").alias("b"), "m", "i", F.explode(F.array_distinct(F.transform(F.sequence("low", "high"), lambda p: F.substring(F.col("k"), p + 1, F.col("size"))))).alias("piece"))
    met = short.join(wide, ["m", "i", "piece"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.filter(indel_ratio(F.col("a"), F.col("b")) >= percent)


def groups(links: DataFrame) -> DataFrame:
    """(node, root) for all that links (a, b) reach; root is the least node of the group.

    A round takes the least label among the neighbours and follows it once; every round is written, which cuts the lineage, until none changes.
    """
    with Work(links.sparkSession) as work:
        both = work.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "groups-links")
        labels = work.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"), F.lit(True).alias("moved")), "groups")
        while True:
            seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("s_node")).agg(F.min("root").alias("low"))
            step = labels.join(seen, F.col("node") == F.col("s_node")).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
            jump = step.select(F.col("node").alias("at"), F.col("root").alias("further"))
            new = step.join(jump, F.col("root") == F.col("at")).select("node", F.least("root", "further").alias("root"), (F.col("old") != F.least("root", "further")).alias("moved"))
            before, labels = labels, work.written(new, "groups")
            work.drop(before)
            if labels.filter("moved").isEmpty():
                return work.keep(labels).select("node", "root")


#: Kinds that may be one entity under different kinds.
FIRM_KINDS = ("VENDOR", "COMPANY", "CUSTOMER")
#: Likeness of names that an employee needs for more than the same name, unless the identifier is one of these.
EMPLOYEE_LIKENESS, SURE_IDENTIFIERS = 65, ("PAN:", "EMAIL:")


def resolve_entities(names: DataFrame, id_col: str, name: str, kind: str, identifier: str | None = None, aliases: DataFrame | None = None, least: int = 85) -> DataFrame:
    """id, key, entity, step, score: the entity of each name (the id of its first name), and how it was found.

    Names come in the order of their ids, which are distinct. One goes to an earlier one by the first step that finds any: the same name in any
    case ("name"); the same identifier ("identifier"); an alias (id, alias) of an earlier id ("alias"); the most similar earlier
    name of a kind that is compatible, by ``least`` percent or more, the earliest of equals ("similar", with its score). Chains
    are followed to their first name. An employee goes by identifier or alias only to names that are alike by 65
    percent, unless the identifier is a tax number or an address. A name without letters is never similar to another.
    """
    with Work(names.sparkSession) as work:
        key, up = canonical_name(F.col(name)), F.upper(F.coalesce(kind, F.lit("")))
        raw = F.col(identifier) if identifier else F.lit(None).cast("string")
        rows = spread(names).select(
            F.col(id_col).alias("id"), F.lower(F.trim(name)).alias("said"), F.coalesce(key, F.lit("")).alias("key"), up.alias("kind"), F.when(up.isin(*FIRM_KINDS), "FIRM").otherwise(up).alias("cls"),
            F.when(F.coalesce(F.trim(raw), F.lit("")) != "", entity_identifier(raw, up)).alias("identifier"),
        )
        rows = work.written(rows, "resolve-names")
        same = lambda c: rows.filter(F.col(c) != "").groupBy(c).agg(F.min("id").alias("to")).join(rows, c).filter("id > to").select("id", "to")
        by_name = same("said").select("id", "to", F.lit(1).alias("rank"), F.lit(100.0).alias("score"))
        keys = rows.select(F.col("id").alias("to"), F.col("key").alias("to_key"))
        likeness = F.udf(lambda a, b: float(word_set_ratio(a, b)), "double")  # of employees' names only
        guard = lambda free: (F.col("kind") != "EMPLOYEE") | free | (F.when(F.col("kind") == "EMPLOYEE", likeness("key", "to_key")) >= EMPLOYEE_LIKENESS)
        sure = F.coalesce(F.col("identifier").startswith(SURE_IDENTIFIERS[0]) | F.col("identifier").startswith(SURE_IDENTIFIERS[1]), F.lit(False))
        by_identifier = same("identifier").join(rows, "id").join(keys, "to").filter(guard(sure)).select("id", "to", F.lit(2).alias("rank"), F.lit(100.0).alias("score"))
        found = by_name.unionByName(by_identifier)
        if aliases is not None:
            known = aliases.select(F.lower(F.trim("alias")).alias("said"), F.col("id").alias("to")).filter("said <> ''").groupBy("said").agg(F.min("to").alias("to"))
            by_alias = rows.join(known, "said").filter("id > to").join(keys, "to").filter(guard(F.lit(False)))
            found = found.unionByName(by_alias.select("id", "to", F.lit(3).alias("rank"), F.lit(100.0).alias("score")))
        forms = work.written(rows.filter("key <> ''").groupBy("cls", "key").agg(F.min("id").alias("first")), "resolve-forms")
        pairs = work.written(similar_names(forms, least), "resolve-pairs")
        both = pairs.select("cls", F.col("a").alias("key"), F.col("b").alias("other"), "score").unionByName(pairs.select("cls", F.col("b").alias("key"), F.col("a").alias("other"), "score"))
        both = both.join(forms.select("cls", F.col("key").alias("other"), F.col("first").alias("to")), ["cls", "other"]).join(forms, ["cls", "key"]).filter("to < first")
        best = both.groupBy("cls", "key").agg(F.max_by(F.struct("to", "score"), F.struct("score", (-F.col("to")).alias("early"))).alias("m")).select("cls", "key", "m.*")
        of_key = rows.filter("key <> ''").join(forms, ["cls", "key"]).join(best, ["cls", "key"], "left")
        # A key that was there before is the same key, else the best of the similar ones.
        by_likeness = of_key.select("id", F.when(F.col("id") > F.col("first"), F.col("first")).otherwise(F.col("to")).alias("to"), F.lit(4).alias("rank"), F.when(F.col("id") > F.col("first"), 100.0).otherwise(F.col("score")).alias("score"))
        found = found.unionByName(by_likeness.filter("to is not null"))
        link = work.written(found.groupBy("id").agg(F.min_by(F.struct("to", "rank", "score"), F.struct("rank", "to")).alias("m")).select("id", "m.*"), "resolve-links")
        roots = groups(link.select(F.col("id").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("id"), "root")
        work.keep(rows)
        work.keep(link)
        step = F.when(F.col("rank") == 1, "name").when(F.col("rank") == 2, "identifier").when(F.col("rank") == 3, "alias").when(F.col("rank") == 4, "similar")
        out = rows.join(roots, "id", "left").join(link, "id", "left")
        return out.select(F.col("id").alias(id_col), "key", F.coalesce("root", "id").alias("entity"), step.alias("step"), "score")
